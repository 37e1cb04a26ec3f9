import random

import pytest

#: Columns whose names operators use themselves; every operator is tried with them beside the text.
EXTRA = {"score": 1.5, "kept": "x", "n_tokens": 7, "row": "r", "label": 3, "key": "k", "n": 1, "cut": "c", "seed": 2, "copy": 9, "n_words": 4, "words": "w"}


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text[, lang, source]) with columns of clashing names added."""

    def build(rows, extra=True):
        rows = [(*r, *("en", "s1")[len(r) - 2 :]) for r in rows]
        schema = "doc_id long, text string, lang string, source string"
        if extra:
            kinds = {int: "int", float: "double", str: "string"}
            schema += "".join(f", {c} {kinds[type(v)]}" for c, v in EXTRA.items())
            rows = [(*r, *EXTRA.values()) for r in rows]
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture
def prose():
    """Random prose of given length, the same for the same seed."""

    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        return " ".join("".join(random.Random(r.randrange(vocabulary)).choice("abcdefghijklmnop") for _ in range(3)) + str(r.randrange(vocabulary)) for _ in range(n))

    return make


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)

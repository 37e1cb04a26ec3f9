import random

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm.quality import QualitySettings, fit_quality, score_quality
from tablewright.llm.toxicity import ToxicityModel, ToxicitySettings, fit_toxicity, folded, score_toxicity


def test_folding():
    assert folded("1d10t, ІDІОT!") == " idiot idiot "  # digits; Cyrillic letters that look Latin
    assert folded("Ｉｄiôt s​tup1d") == " idiot stupid "
    assert folded("in 2020 - 7 times") == " in 2020 7 times "
    assert folded("") == " "


def test_entries_begin_words_and_exceptions_spare(spark):
    model = ToxicityModel({"scum": 3.0, "trash": 2.0}, [" pond scum "], None)
    assert sorted(w for _, w in model.hits(folded("Scum! trashy, 5cum, unscummed pond scum"))) == [2.0, 3.0, 3.0]
    assert ToxicityModel({}, [], None).hits(" a ") == []


def labelled(spark, documents, make, n=600):
    rows, labels = [], []
    for i in range(n):
        text, label = make(i)
        rows.append((i, text))
        labels.append((i, label))
    rows += [(n, None), (n + 1, ""), (None, "word"), (0, rows[0][1])]
    labels += [(n, None), (None, 1), (0, labels[0][1]), (1, 1 - labels[1][1])]
    return documents(rows), spark.createDataFrame(labels, "doc_id long, mark int")


def test_toxicity_is_learned_and_held_out_rows_are_right(spark, documents, prose):
    bad, stems = ["idiot", "scum"], ["zorqua", "vlomi"]

    def make(i):
        r = random.Random(i)
        words = prose(i, 30).split()
        if i % 7 == 0:
            words[r.randrange(30)] = r.choice([*bad, *(s + r.choice(["en", "ist", "o", "ung"]) for s in stems)])
        elif i % 5 == 0:
            words[10:12] = ["pond", "scum"]
        return " ".join(words), int(i % 7 == 0)

    docs, labels = labelled(spark, documents, make)
    model = fit_toxicity(docs, labels, F.col("doc_id") % 4 != 0, ToxicitySettings(evidence=8.0, odds=1.0), label="mark")
    found = score_toxicity(docs, model)
    assert found.columns == [*[c for c in docs.columns if c != "score"][:4], *found.columns[4:]] and "score" in found.columns
    rows = {r["doc_id"]: r["score"] for r in found.collect() if r["doc_id"] is not None}
    held = [i for i in range(600) if i % 4 == 0 and i > 1]
    right = np.mean([(rows[i] >= 0.5) == (i % 7 == 0) for i in held])
    assert right > 0.95 and all(0 <= v <= 1 for v in rows.values()) and rows[600] == rows[601]


def test_quality_is_learned_and_held_out_rows_are_right(spark, documents, prose):
    def make(i):
        text = prose(i, 80, 3000)
        kind = i % 6
        return (" | ".join(text.split()) if kind == 0 else (text[:6] + " ") * 60 if kind == 1 else text), int(kind > 1)

    docs, labels = labelled(spark, documents, make)
    model = fit_quality(docs, labels, F.col("doc_id") % 4 != 0, QualitySettings(), label="mark")
    rows = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect() if r["doc_id"] is not None}
    right = np.mean([(rows[i] >= 0.5) == (i % 6 > 1) for i in range(4, 600, 4)])
    assert right > 0.95 and all(0 <= v <= 1 for v in rows.values())


def test_without_labels_every_text_scores_alike(spark, documents):
    docs = documents([(1, "a"), (2, None)])
    for rows, want in (([], 0.5), ([(1, 1), (2, 1)], 0.999)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        for out in (
            score_quality(docs, fit_quality(docs, labels, F.lit(True))),
            score_toxicity(docs, fit_toxicity(docs, labels, F.lit(True), label="quality")),
        ):
            assert {round(r["score"], 3) for r in out.collect()} == {want}
    empty = documents([])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert score_quality(empty, fit_quality(empty, labels, F.lit(True))).count() == 0

"""Phrase collocations against a count of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import collocations as module
from tablewright.llm.collocations import Collocations, _told_counts, coded, collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, settings):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, settings.longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: f for p, f in own.items() if len(p) > 1 and f >= settings.support}
        inside = {}
        for p, f in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(f, inside.get(p[i:j], 0))
        found = []
        for p, a in candidates.items():
            if 100 * inside.get(p, -1) >= settings.absorbed * a:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((" ".join(p), a, left, right, n[lang], score))
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(found[: settings.top])]
    return sorted(out)


def texts(seed, n, words=14, marks=".,;:!?\n\r\t "):
    r = random.Random(seed)
    vocabulary = [*"abcDEfgh", "straße", "ünd", "\x1c", "a\x00b", "it's", "x-y"]
    return ["".join(r.choice(vocabulary) + (" " if r.random() < 0.8 else r.choice(marks)) for _ in range(r.randrange(words))) for _ in range(n)]


def run(spark, rows, settings, parts=3):
    docs = spark.createDataFrame([(i, lang, text, "x", 1, "y") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, f long, position string")
    return sorted(tuple(r) for r in collocations(docs.repartition(parts), settings).collect())


@pytest.mark.parametrize(
    ("support", "shard_words", "part_words", "bits", "absorbed"),
    [(3, 1 << 22, 1 << 20, 25, 100), (4, 50, 50, 25, 100), (5, 200, 30, 18, 60), (2, 20, 10, 15, 100), (4, 1 << 22, 40, 25, 100)],
)
def test_against_all_phrases(spark, support, shard_words, part_words, bits, absorbed):
    # 2 ** 15 bits are a single block.
    settings = Collocations(support=support, shard_words=shard_words, part_words=part_words, bits=bits, absorbed=absorbed)
    rows = [(random.Random(i).choice(["en", "de", None, "und", ""]), t) for i, t in enumerate([*texts(1, 150), *texts(2, 30, 60), None, "", " ", "...", "a a a a a a a a"])]
    rows += [("en", "big apple pie big apple pie")] * 7  # repeated rows
    assert run(spark, rows, settings) == by_hand(rows, settings)


def test_long_text_makes_several_parts(spark):
    text = " ".join(texts(3, 600, 30))
    settings = Collocations(support=12, shard_words=200, part_words=100)
    assert run(spark, [("en", text)], settings, 1) == by_hand([("en", text)], settings)
    whole = Collocations(support=12, part_words=1000)
    one_piece = re.sub(r"[.,;:!?\n\r]", " ", text)
    assert run(spark, [("en", one_piece)], whole, 1) == by_hand([("en", one_piece)], whole)


def test_ranks_stop_at_the_top_and_ties_go_by_bytes(spark):
    rows = [("en", f"{a} {b}") for a, b in [("zz", "é1"), ("a", "b"), ("ä", "c"), ("Z", "d")] for _ in range(3)]
    settings = Collocations(support=3, top=3)
    assert run(spark, rows, settings) == by_hand(rows, settings)
    assert [r[2] for r in run(spark, rows, settings)] == ["a b", "z d", "zz é1"]


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from tablewright.llm import collocations as module

    # The score's arithmetic alone, on counts that no test corpus has.
    a, n, left, right = 10**12 + 7, 9 * 10**17 + 1, 3 * 10**12 + 1, 7 * 10**12 + 3
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(module.score().alias("s"))
    assert row.first()["s"] == 1000 * a * n // (left * right)
    assert row.select(F.typeof("s")).first()[0] == "bigint"


def test_nothing_to_find(spark):
    settings = Collocations(support=2)
    assert run(spark, [], settings) == []
    assert run(spark, [(None, None), ("en", ""), ("en", " .\n")], settings) == []
    assert run(spark, [("en", "a b")], settings) == []


def test_a_phrase_is_told_once_by_each_core_not_by_each_shard(spark):
    texts = [f"one two three four five {i % 7}" for i in range(400)]
    source = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(40)
    settings = Collocations(support=2, shard_words=16, count_words=16, part_words=16, bits=20)
    every = spark.sparkContext.broadcast(np.full(1 << 17, 255, np.uint8))
    told = _told_counts(coded(source, settings.part_words), settings, range(2, 3), every, None, every)
    by_phrase = told.groupBy("phrase").agg(F.count("*").alias("n"), F.sum("f").alias("f")).collect()
    wanted = Counter(" ".join(t.split()[i : i + 2]) for t in texts for i in range(5))
    assert {r["phrase"]: r["f"] for r in by_phrase} == wanted
    assert max(r["n"] for r in by_phrase) <= spark.sparkContext.defaultParallelism


def test_tasks_get_the_corpus_in_small_batches(spark, tmp_path, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    spark.range(0, 40, 1, 1).selectExpr("cast(repeat('x', 1000000) as binary) as codes").write.parquet(str(tmp_path / "rows"))
    largest = []

    class Probed(module.Scratch):
        def save(self, df, *args, **kwargs):
            largest.append(spark.read.parquet(str(tmp_path / "rows")).coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0])
            return super().save(df, *args, **kwargs)

    monkeypatch.setattr(module, "Scratch", Probed)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = [("en", "big apple pie")] * 5
    assert run(spark, rows, Collocations(support=3)) == by_hand(rows, Collocations(support=3))
    # All but the last save are of steps that hand Python the corpus or what it told.
    assert len(largest) > 5 and max(largest[:-1]) <= 10_000_000
    assert spark.conf.get(key) == before
    spark.conf.set(key, "2m")
    try:
        largest.clear()
        run(spark, rows, Collocations(support=3))
        assert max(largest) <= 4_000_000 and spark.conf.get(key) == "2m"
    finally:
        spark.conf.set(key, before)


def test_a_task_tells_many_phrases_once(spark):
    words = 560
    rows = [("en", ".".join(f"{a} {b}" for b in range(a + 1, words))) for a in range(words)] * 2
    settings = Collocations(support=2, count_words=1 << 14, part_words=1 << 12, bits=20)
    source = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    every = spark.sparkContext.broadcast(np.full(1 << 17, 255, np.uint8))
    told = _told_counts(coded(source, settings.part_words), settings, range(2, 3), every, None, every)
    pairs = words * (words - 1) // 2
    assert tuple(told.agg(F.count("*"), F.sum("f"), F.min("f")).first()) == (pairs, 2 * pairs, 2)

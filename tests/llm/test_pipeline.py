import os

import pytest

import corpus_pipeline
from tablewright.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, documents, tmp_path_factory):
    """A corpus with planted cases; where it lies, and its documents."""
    import random

    def prose(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(2, 8))) for _ in range(n))

    good = [(i, prose(i, 60 + 7 * (i % 30)), "en", f"s{i % 3 if i % 10 else 0}") for i in range(200)]
    junk = [(1000 + i, " | ".join(prose(500 + i, 90).split()), "en", "s1") for i in range(60)]
    near = [(2000 + i, good[i][1] + " one more", "en", "s2") for i in range(10)]
    passage = prose(900, 60)
    shared = [(3000 + i, f"{prose(910 + i, 80)} {passage} {prose(930 + i, 80)}", "en", "s0") for i in range(5)]
    leaked = [(4000 + i, f"{prose(950 + i, 80)} {prose(970, 30)} {prose(990 + i, 80)}", "en", "s0") for i in range(2)]
    odd = [(5000, None, None, None), (5001, "", "en", "s0"), (None, prose(999, 100), "en", "s0"), (5, good[5][1], "en", "s2")]
    rows = good + junk + near + shared + leaked + odd
    docs = documents(rows)
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs.selectExpr("*", "cast(length(text) as bigint) as n_chars").write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, 0) for r in good[:120]] + [(r[0], 0, 0) for r in junk[:40]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, prose(970, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, passage


def test_stages_catch_what_is_planted(spark, corpus):
    folder, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
    clean = set(range(10, 200))
    assert clean <= set(seen["quality"]) and not set(range(1000, 1060)) & set(seen["quality"])
    assert clean <= set(seen["near-duplicates"]) and not set(range(2000, 2010)) & set(seen["near-duplicates"]) and None in seen["near-duplicates"]
    passages = seen["repeated-passages"]
    assert passage in passages[3000]["text"] and all(passage not in passages[3000 + i]["text"] for i in range(1, 5))
    assert passages[3001]["n_chars"] == len(passages[3001]["text"]) and all(passages[i]["text"] == seen["quality"][i]["text"] for i in clean)
    # The second document with the item lost it as a repeated passage; the first one goes.
    assert clean | {4001} <= set(seen["benchmark-leaks"]) and 4000 not in seen["benchmark-leaks"]
    assert set(seen["mixture"]) <= set(seen["benchmark-leaks"])


def test_rows_without_an_id_and_texts_of_one_id_are_decided_one_by_one(spark, documents, prose, tmp_path):
    item = prose(1, 30, 5000)
    texts = {i: prose(10 + i, 80, 5000) for i in range(8)}
    bad = f"{prose(30, 60, 5000)} {item}"
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[3]), (3, texts[3] + " more"), (4, texts[3].upper())]
    rows += [(None, texts[4]), (None, texts[4]), (None, texts[4] + " more"), (None, texts[5]), (None, texts[0]), (None, texts[1] + " more")]
    leaking = [(None, bad), (5, bad + " x"), (5, texts[6])]
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, rows):
        return [(r["doc_id"], r["text"]) for r in stage(spark, documents(rows), str(tmp_path)).collect()]

    got = left(corpus_pipeline.without_near_duplicates, rows)
    assert {(1, texts[0]), (2, texts[1]), (3, texts[2]), (None, texts[5])} <= set(got) and len(got) == 6
    assert len({(3, texts[3]), (3, texts[3] + " more")} & set(got)) == 1
    assert len({(None, texts[4]), (None, texts[4] + " more")} & set(got)) == 1
    got = left(corpus_pipeline.without_leaks, rows + leaking)
    assert sorted(map(repr, got)) == sorted(map(repr, [*rows, leaking[2]]))


def test_run_gives_the_last_stage_s_rows(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert {"doc_id", "text", "copy", "n_tokens"} <= set(out.columns) and out.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_give_the_rows_of_their_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = db.execute(f"select {', '.join(f'{c!r}'.replace(chr(39), chr(34)) for c in columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.select(*columns).collect())

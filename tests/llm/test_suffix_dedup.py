import hashlib
import random

import pytest

from tablewright.llm.suffix_dedup import Repeats, without_repeats


def brute(rows, length):
    """{doc_id: (bytes, removed, spans, digest)} from all passages in order."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(data[i : i + length])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    def text(n): return "".join(r.choice("abü \n") for _ in range(n))
    passages = [text(r.randrange(20, 90)) for _ in range(12)]
    rows = []
    for doc in range(120):
        parts = [text(r.randrange(0, 60)) if r.random() < 0.6 else r.choice(passages) for _ in range(r.randrange(0, 8))]
        rows.append((doc * 3, "".join(parts)))
    rows += [(1000, rows[7][1]), (1001, "ab" * 500), (1002, "x" * 300), (1003, "x" * 39), (1004, None), (1005, "")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [Repeats(length=40, seed=16), Repeats(length=30, seed=8, bucket_bytes=1), Repeats(length=100)])
def test_the_same_bytes_go_as_in_brute_force(documents, settings):
    rows = corpus(settings.length)
    found = without_repeats(documents(rows), settings, digest=True).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    assert got == brute(rows, settings.length)


def test_texts_and_other_columns_are_kept(documents):
    passage = "one passage that is repeated over here. "
    docs = documents([(1, passage + "first"), (2, "second " + passage), (None, passage), (3, None), (4, passage), (4, passage)])
    found = without_repeats(docs, Repeats(length=32, seed=16))
    assert found.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans"]
    got = sorted((r["doc_id"] or 99, r["text"], r["n_removed"], r["score"], r["cut"]) for r in found.collect() if r["doc_id"] != 3)
    n = len(passage)
    assert got == [(1, passage + "first", 0, 1.5, "c"), (2, "second ", n, 1.5, "c"), (4, "", n, 1.5, "c"), (4, "", n, 1.5, "c"), (99, "", n, 1.5, "c")]
    assert [r["text"] for r in found.where("doc_id = 3").collect()] == [None]


def test_texts_that_share_an_id_or_have_none_are_documents_of_their_own(documents):
    r = random.Random(5)
    passages = ["".join(r.choice("abcdefgh \n") for _ in range(60)) for _ in range(6)]

    def text(parts):
        return "".join("".join(r.choice("abcdefgh") for _ in range(100)) if p is None else passages[p] for p in parts)

    for parts in (1, 5):
        # The repeated passages stand at equal and at other places, and where one text repeats, another holds text of its own.
        rows = [(1, text([None, 0, None])), (3, text([None, 1])), (3, text([None, 1, None])), (3, text([2, None]))]
        rows += [(None, text(p)) for p in ([None, 3, None], [None, 3, None, 0], [None, 4], [None, None, None], [2, None, 4])]
        found = without_repeats(documents([*rows, rows[4], rows[1]]).repartition(parts), Repeats(length=40, seed=16), digest=True).collect()
        spark = documents(rows).sparkSession
        keys = spark.createDataFrame(list(enumerate(t for _, t in rows)), "i int, t string").selectExpr("i", "xxhash64(t) as k").collect()
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0] or 99, keys[i]["k"]))
        want = brute([(place, rows[i][1]) for place, i in enumerate(order)], 40)
        want = [((rows[i][0] or 99), *want[place]) for place, i in enumerate(order)]
        got = sorted((x["doc_id"] or 99, x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in found)
        again = [want[order.index(i)] for i in (4, 1)]
        assert got == sorted([*want, *again])


def test_empty_table_and_very_long_text(documents, monkeypatch):
    assert without_repeats(documents([]), digest=True).count() == 0
    from tablewright.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "_SLICE", 500)
    r = random.Random(2)
    long = "".join(chr(r.randrange(97, 117)) for _ in range(3000))
    a = suffix_dedup.sliced_anchors([long.encode()] * 1, Repeats(length=50, seed=16))
    starts = sorted(s for x in a for lo, more in zip(x.start, x.more, strict=True) for s in range(lo, lo + more + 1))
    assert starts == list(range(3000 - 50 + 1))

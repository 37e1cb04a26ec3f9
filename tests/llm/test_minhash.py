import random

import numpy as np
import pytest

from tablewright.llm.common import components, Scratch, encoded, shingle_sets
from tablewright.llm.minhash import NearDuplicates, estimate, merged, near_duplicates, sketch


def brute(rows, size, percent):
    """{doc_id: (n_shingles, component)} by comparing every pair of documents."""
    sets = {}
    for doc, text in rows:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
        sets[doc] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(w if r.random() >= share else f"new{r.randrange(10**6)}" for w in text.split())


@pytest.mark.parametrize("block", [3, 128])
def test_all_links_of_groups_of_near_copies(documents, prose, block):
    rows = []
    for group in range(4):
        base = prose(group, 120)
        rows += [(100 * group + i, edited(base, 1000 * group + i, 0.005 * (i % 12))) for i in range(30)]
    rows += [(900 + i, prose(50 + i, 40)) for i in range(20)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1].upper()), (1002, "one two"), (1003, "One  two"), (1004, "two one")]
    random.Random(1).shuffle(rows)
    want = brute(rows, 4, 80)
    found = near_duplicates(documents(rows), NearDuplicates(shingle=4, register_block=block, text_block=block)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_chained_buckets_of_templates(documents, prose):
    """Templates that share a third to a half of their text, some with copies of their own: buckets chain far beyond the links."""
    r = random.Random(8)
    rows = []
    for i in range(120):
        shared = [prose(r.randrange(6), 30) for _ in range(2)]
        own = prose(1000 + i, 35)
        rows.append((10 * i, " ".join([shared[0], own, shared[1]])))
        if i % 3 == 0:
            rows += [(10 * i + k, edited(rows[-1][1], 77 * i + k, 0.01 * k)) for k in range(1, 6)]
    found = near_duplicates(documents(rows), NearDuplicates(shingle=4, bands=60, rows=2, register_block=16, text_block=8)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 4, 80)


def test_empty_missing_and_repeated_rows(documents):
    text = "a b c d e f g"
    found = near_duplicates(documents([(5, None), (4, ""), (3, " \t\n"), (None, text), (7, text), (7, text), (9, "x" * 100_000)])).collect()
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in found)
    assert got == [(0, 3, 7, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (7, 3, 7, True), (7, 3, 7, True), (9, 1, 9, True)]


def test_empty_table(documents):
    out = near_duplicates(documents([]))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_registers_merge_and_estimate():
    settings = NearDuplicates()
    r = np.random.default_rng(3)
    common, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    left, right = sketch(np.concatenate((common, a)), settings), sketch(np.concatenate((common, b)), settings)
    assert (merged(left, right) == sketch(np.concatenate((common, a, b)), settings)).all()
    found = estimate(left[None], right[None], np.array([900.0]), np.array([900.0]), settings.base)
    assert abs(found[0] - 0.8) < 0.1


def test_words_are_split_at_ascii_space_only():
    one, other, third = shingle_sets([encoded("A b c"), encoded("a b\x0bc"), encoded("a b c")], 2)
    assert (one == other).all() and len(one) == 1 and len(third) == 2


def test_components_are_labelled_by_their_smallest_node(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    top = {}
    for a, b in edges:
        top.setdefault(a, a), top.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    found = components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long"))
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in found.collect()} == {k: v for k, v in top.items() if k not in loops}

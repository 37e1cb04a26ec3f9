import itertools
import random
import re
from collections import Counter

import pytest

from tablewright.llm.decontamination import Decontamination, leaks, masks_of
from tablewright.llm.licenses import scan_licenses
from tablewright.llm.quality_rules import quality_rules


def texts():
    r = random.Random(4)
    rows = []
    for i in range(60):
        words = [r.choice(["aa", "bü", "c#", "d|", "e"]) for _ in range(r.randrange(0, 40))]
        rows.append((i, "".join(w + r.choice([" ", "\n", "\t", "\x0b", "  "]) for w in words)))
    line = "a line of words"
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, "\n".join([line] * 5)), (None, "x y"), (7, rows[7][1]), (104, "w " * 30_000)]


def test_counts_are_those_of_brute_force(documents):
    rows = texts()
    found = quality_rules(documents(rows)).collect()
    assert len(found) == len(rows)
    by_id = dict(rows)
    for r in found:
        text = by_id[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_outliers_of_a_group_go_and_clean_documents_stay(documents, prose):
    rows = [(i, prose(i, 60 + i % 200, 3000), "en", "s1") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "***" for w in prose(i, 80, 3000).split()), "en", "s1") for i in range(40)]
    few = [(2000, prose(7, 90, 3000), None, None), (2001, " | ".join(prose(8, 90, 3000).split()), "fr", "s9")]
    found = {r["doc_id"]: r["kept"] for r in quality_rules(documents(rows + junk + few)).collect()}
    assert all(found[i] for i in range(300)) and not any(found[1000 + i] for i in range(40))
    assert found[2000] and not found[2001]


def test_quality_rules_of_an_empty_table(documents):
    assert quality_rules(documents([])).count() == 0


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_tolerate_substitutions_and_spare_others(spark, documents, prose):
    items = [(i, prose(100 + i, 20 + i)) for i in range(10)]
    rows = [(i, f"{prose(i, 50)} {items[i][1].upper()}. {prose(200 + i, 30)}") for i in range(5)]
    replaced = items[5][1].split()
    replaced[6] = "other"
    replaced[18] = "another"
    rows += [(20, prose(20, 30) + " " + " ".join(replaced)), (21, items[6][1]), (22, None), (23, ""), (24, prose(24, 4000)), (None, items[7][1]), (3, rows[3][1])]
    rows += [(25, " ".join(items[8][1].split()[:9])), (26, prose(26, 10) + " " + items[8][1])]
    found = leaks(documents(rows), bench(spark, [*items, (50, "too short"), (51, None), (6, items[6][1])])).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got == {*((i, i) for i in range(5)), (20, 5), (21, 6), (None, 7), (26, 8)} and len(found) == len(got)
    at = {r["doc_id"]: r for r in found}
    assert at[26]["first_word"] == 10 and at[26]["n_equal"] == at[26]["n_item"] == 28 and at[20]["n_equal"] == 23


def accepted(n):
    """Places of an item of n words that may differ, in every way that the comparison of a window accepts."""
    most = n - (80 * n + 99) // 100
    return [gone for k in range(most + 1) for gone in itertools.combinations(range(n), k)]


@pytest.mark.parametrize("n", range(1, 14))
def test_masks_hit_every_alignment_that_is_accepted(n):
    masks = masks_of(n, Decontamination())
    assert all(any(not {i + o for o in m} & set(gone) for m in masks for i in range(n - max(m))) for gone in accepted(n))


def test_short_items_and_all_substitutions_are_found(spark, documents):
    items, rows, want = [], [], set()
    for n in (1, 4, 6, 8, 10, 13):
        words = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for gone in accepted(n):
            rows.append((len(rows), " ".join(["before", *("other" if i in gone else w for i, w in enumerate(words)), "after"])))
            want.add((rows[-1][0], n))
        rows.append((len(rows), " ".join(w for i, w in enumerate(words) if i >= n - (80 * n + 99) // 100 + 1)))  # one word too few
    found = leaks(documents(rows), bench(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want)


def test_leaks_of_empty_tables(spark, documents):
    assert leaks(documents([]), bench(spark, [(1, "a b c")])).count() == 0
    assert leaks(documents([(1, "a b c")]), bench(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text, base, labels, first, last, n",
    [
        ("Released under the MIT License.", "mit", "mit", 3, 3, 1),
        ("x Apache-License y general public license, mit\nlicense", "apache,gpl,mit", "apache,gpl,mit", 1, 7, 3),
        ("Licensed under CC BY-NC 4.0 and more", "", "cc-by-nc", None, None, 0),
        ("Redistribution and use in source and binary forms with or without any modification are permitted provided that the following conditions are met", "", "bsd", None, None, 0),
        ("emit license; mit licenses; general public", "", "", None, None, 0),
        ("ümit license", "", "", None, None, 0),
        (None, "", "", None, None, 0),
    ],
)
def test_licenses(documents, text, base, labels, first, last, n):
    (r,) = scan_licenses(documents([(1, text)])).collect()
    assert (r["base_labels"], r["labels"], r["first_word"], r["last_word"], r["n_base"]) == (base, labels, first, last, n)
    assert (r["score"] > 0) == bool(labels) and 0 <= r["score"] <= 1


def test_licenses_of_repeated_rows_missing_ids_and_no_rows(documents):
    rows = [(1, "the mit license"), (1, "the mit license"), (None, "mit license"), (2, "word " * 5000 + "apache license"), (3, "")]
    found = sorted((r["doc_id"] or 0, r["n_words"], r["first_word"], r["labels"]) for r in scan_licenses(documents(rows)).collect() if r["doc_id"] != 3)
    assert found == [(0, 2, 0, "mit"), (1, 3, 1, "mit"), (1, 3, 1, "mit"), (2, 5002, 5000, "apache")]
    assert scan_licenses(documents([])).count() == 0
    assert Decontamination().window == 13


@pytest.mark.parametrize(("notice", "label"), [
    ("This post is licensed under a Creative Commons Attribution 4.0", "cc-by"),
    ("Licensed under a Creative Commons Attribution 4.0", "cc-by"),
    ("This work is licensed under the Creative Commons Attribution 4.0", "cc-by"),
    ("This Source Code File is subject to the terms of the Mozilla Public License", "mpl"),
    ("Licensed under CC BY-NC", "cc-by-nc"),
    ("They were licensed under the old rules of the town", ""),
])
def test_one_changed_word_leaves_a_licence_known(documents, notice, label):
    row = scan_licenses(documents([(1, f"Some words before. {notice}, and some words behind.")])).first()
    assert row["labels"] == label and (row["score"] >= 0.8) == bool(label)

"""Conversation repair against a plain dynamic program over (cost, audit)."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tablewright.llm.conversations import Blocks, damaged, doubled, repair, repair_report

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NAMES = {"u": "user", "a": "assistant"}


def after_damage(rows):
    """Turns of each conversation after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        of = " " if conv is None else conv, " " if turn is None else turn
        fate = zlib.crc32(f"{of[0]}:{of[1]}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for own in out.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2][:64].encode(), hashlib.md5(x[2].encode()).hexdigest()))
    return out


def by_hand(conv, rows):
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    seen, faults = set(), []
    for _, role, text in rows:
        ink = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    later = None
    for i in range(len(rows), -1, -1):
        here = {}
        for state in ("", "s", "u", "a"):
            ways = [(10**9, "")]
            if i == len(rows):
                ways += [(0, "")] if state in ("", "a") else []
            else:
                extra = 3 if faults[i] == "truncated" else 0
                ways.append((later[state][0] + 4, "D" + later[state][1]))
                if faults[i] not in ("blank", "duplicate"):
                    for letter, price, to in [("K", 0, initials[i]), ("R", 3, "u"), ("R", 3, "a")]:
                        if (state, to) in NEXT:
                            cost, audit = later[NEXT[state, to]]
                            ways.append((cost + price + extra, letter + audit))
            here[state] = min(ways)
        bare = dict(here)
        for _ in range(4):
            here = {s: min([bare[s]] + [(here[to][0] + 3, "I" + here[to][1]) for to in "ua" if (s, to) in NEXT]) for s in here}
        later = here
    cost, audit = later[""]
    state, lines, rest = "", [], iter(zip(rows, initials, strict=True))
    for edit in audit:
        if edit == "I":
            state = "a" if state == "u" else "u"
            lines.append(f"{NAMES[state]}:")
            continue
        (_, role, text), initial = next(rest)
        if edit == "R":
            state = "a" if state == "u" else "u"
            role = NAMES[state]
        if edit == "K":
            state = initial
        if edit != "D":
            lines.append(f"{role}:{text}")
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, n, longest, roles=("user", "assistant", "system", "tool", "u", "", None)):
    r = random.Random(seed)
    texts = ["Yes.", "Why?", "No", "", " \t", "Done!", "cut off", None, "é.", "a" * 70 + ".", "a" * 70 + "!"]
    rows = []
    for conv in range(n):
        turns = r.randrange(longest)
        for turn in range(turns):
            odd = r.random()
            role = r.choice(roles) if odd < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv if conv else None, None if odd > 0.97 else turn - (odd > 0.95), role, r.choice(texts) if r.random() < 0.4 else f"t{r.randrange(50)}."))
    return rows


def frame(spark, rows, parts=3):
    schema = "conv_id long, turn long, role string, text string, key string, part string, seq int, audit string, code string, place long"
    return spark.createDataFrame([(*r, "k", "p", 1, "a", "c", 2) for r in rows], schema).repartition(parts)


@pytest.mark.parametrize(("seed", "n", "longest", "shuffled"), [(1, 60, 9, 2), (2, 3, 300, 16), (3, 1, 500, 7)])
def test_against_a_plain_program(spark, seed, n, longest, shuffled):
    rows = made(seed, n, longest)
    rows += rows[:: max(1, len(rows) // 5)]  # repeated rows
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    try:
        got = [tuple(r) for r in repair_report(frame(spark, rows)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = [by_hand(conv, own) for conv, own in after_damage(rows).items()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_repaired_turns_are_legal(spark):
    rows = made(4, 20, 12, ("user", "assistant", "system"))
    found = repair(damaged(frame(spark, rows))).turns.orderBy("key", "place").collect()
    initials, text = {}, {r[3] for r in rows}
    for row in found:
        initials[row["key"]] = initials.get(row["key"], "") + row["role"][0]
        assert row["edit"] in "KRI"
    assert initials
    assert all(re.fullmatch("(s?(ua)+)?", i) for i in initials.values())
    assert text


def test_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = [tuple(r) for r in repair_report(frame(spark, [(gone, 0, "user", "Hello.")])).collect()]
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert repair_report(frame(spark, [])).collect() == []


def test_long_text(spark):
    rows = [(7, 1, "user", "word " * 400_000 + "."), (7, 2, "assistant", "ok")]
    assert [tuple(r) for r in repair_report(frame(spark, rows)).collect()] == [by_hand(7, after_damage(rows)[7])]


def test_ranks_by_doubling():
    r = random.Random(5)
    n = 200
    target = np.array([r.randrange(i) if i else 0 for i in range(n)])
    letter = np.array([0, *[r.randrange(1, 4) for _ in range(n - 1)]])

    def word(i):
        return "" if not letter[i] else chr(96 + letter[i]) + word(target[i])

    rank, _ = doubled(target, letter)
    words = [word(i) for i in range(n)]
    order = {w: k for k, w in enumerate(sorted(set(words)))}
    assert [order[w] for w in words] == rank.tolist()


def test_no_blocks():
    assert Blocks([]).back(np.zeros((0, 4), np.int64))[0].shape == (0, 4)

"""Repair of conversations whose turns are missing, repeated, empty, cut off or out of turn.

The cheapest edits that make the roles of a conversation legal are a shortest path through nodes (turn, state of the grammar), and
of equally cheap edits the ones whose letters come first in ASCII are taken. Conversations are cut into blocks where the sorted rows
are cut into partitions, so that the longest one is spread over tasks as well:

* each block gives the costs from every state at its start to every state at its end; joined from the last block to the first they
  give the cost to go at each border;
* with that, a block knows which of its arcs are optimal. Its nodes are ranked by the first 1, 2, 4, ... letters of their least audit,
  where a rank of doubled length is the pair of the node's rank and that of the node its pointer leads to. Each node takes the arc of
  the least letter and rank, and the letters of its path are read through the doubled pointers, all places at once;
* the states in which the paths leave the blocks are joined from the first block to the last.

Texts take no part in this: they pass once, in order, through the tasks that write the repaired turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch, shuffle_parts

SPACE = " \t\n\x0b\x0c\r"
FAR = 1 << 60
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What an undeleted turn that is cut off adds.
CUT_OFF = 3
#: States of the grammar `(s?(ua)+)?`: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or re-roled turn leads to, and the role it gets.
TURN = np.array([USER, USER, ASSISTANT, USER])
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after keeping a turn of initial s, u, a or another one; -1 where the grammar forbids it.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1] * 4])
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
#: Letters of the edits in ASCII order, from 1; 0 is the end of an audit.
LETTERS = np.array(list(" DIKR"))
#: A turn's code: its initial (0 to 3), 4 if it must go, 8 if it is cut off.
MUST_GO, IS_CUT = 4, 8


@dataclass(frozen=True)
class Names:
    """The columns of a table of turns."""

    conversation: str = "conv_id"
    turn: str = "turn"
    role: str = "role"
    text: str = "text"


# ---------------------------------------------------------------------------------------------------------------------
# Rows


def damaged(turns: DataFrame, names: Names = Names()) -> DataFrame:
    """conv_id, turn, role, text after damage chosen by crc32 of `conv_id:turn`: of 20 remainders 0 drops a row, 1 empties its text,
    2 removes its `.!?`, 3 repeats it, 4 gives it the role user. A NULL is one space, except that conv_id and turn stay NULL."""
    spaced = {c: F.coalesce(F.col(f"`{of}`").cast("string"), F.lit(" ")) for c, of in vars(names).items()}
    fate = F.crc32(F.concat(spaced["conversation"], F.lit(":"), spaced["turn"]).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(spaced["text"], ".!?", "")).otherwise(spaced["text"])
    rows = turns.select(
        F.col(f"`{names.conversation}`").alias("conv_id"),
        F.col(f"`{names.turn}`").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(spaced["role"]).alias("role"),
        text.alias("text"),
        fate.alias("fate"),
    )
    rows = rows.where("fate <> 0").withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.drop("fate", "copy")


def key_of(column: str) -> Column:
    """A conversation's id as text that is never NULL."""
    return F.when(F.col(column).isNull(), "n").otherwise(F.concat(F.lit("i"), F.col(column).cast("string")))


def in_order(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with `key`, and with their place (part, seq), stored in the order of conversations and turns.

    Turns of one number are ordered by role and text (its first 64 characters, then its digest). The last sort key tells all rows
    apart, so a conversation of any length, and any number of equal rows, are dealt over partitions.
    """
    keyed = rows.withColumns({"key": key_of("conv_id"), "head": F.substring("text", 1, 64), "digest": F.md5(F.col("text").cast("binary")), "n": F.monotonically_increasing_id()})
    by = ["key", "turn", "role", "head", "digest", "n"]
    dealt = keyed.repartitionByRange(shuffle_parts(rows), *by).sortWithinPartitions(*by)
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    dealt = dealt.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id(), "end": F.substring(end, -1, 1)})
    return scratch.save(dealt.drop("head", "n"))


def faults(rows: DataFrame) -> DataFrame:
    """key, part, seq, turn, code, blank, duplicate, truncated of every row: the first fault that applies is set."""
    seen = rows.where("end <> ''").groupBy("key", "role", "digest").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n"))
    seen = seen.where("n > 1").drop("n")
    rows = rows.select("key", "part", "seq", "turn", "role", "digest", "end").join(seen, ["key", "role", "digest"], "left")
    blank = F.col("end") == ""
    duplicate = ~blank & F.col("first").isNotNull() & (F.struct("part", "seq") != F.col("first"))
    duplicate = F.coalesce(duplicate, F.lit(False))
    truncated = ~blank & ~duplicate & ~F.col("end").isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = code + F.when(blank | duplicate, MUST_GO).otherwise(0) + F.when(truncated, IS_CUT).otherwise(0)
    return rows.select("key", "part", "seq", "turn", code.cast("int").alias("code"), blank.alias("blank"), duplicate.alias("duplicate"), truncated.alias("truncated"))


# ---------------------------------------------------------------------------------------------------------------------
# Paths


class Blocks:
    """Blocks of turns side by side, the longest first: row r of block b is at[b] + r."""

    def __init__(self, codes: list[bytes]):
        self.order = np.argsort([-len(c) for c in codes], kind="stable")
        self.lengths = np.array([len(codes[i]) for i in self.order], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.codes = np.frombuffer(b"".join(codes[i] for i in self.order), np.uint8).astype(np.int64)
        initial, must_go = self.codes & 3, self.codes & MUST_GO > 0
        # For every row and state: where keeping leads and what keeping and re-roling cost.
        self.kept = KEPT[initial]
        extra = np.where(self.codes & IS_CUT > 0, CUT_OFF, 0)[:, None]
        self.keep_cost = np.where(must_go[:, None] | (self.kept < 0), FAR, KEEP + extra)
        self.rerole_cost = np.where(must_go[:, None], FAR, REROLE + extra) + np.zeros((1, 4), np.int64)
        self.kept = np.maximum(self.kept, 0)

    def back(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(costs before each row, costs at each block's start) to go from every state, given those at the blocks' ends; ends has
        the shape (blocks, 4, ...). An insertion belongs to the row that it stands before."""
        now = ends.copy()
        before = np.empty((len(self.codes), *ends.shape[1:]), np.int64)
        wide = (slice(None), slice(None), *[None] * (ends.ndim - 2))
        for step in range(int(self.lengths.max(initial=0))):
            m = int(np.searchsorted(-self.lengths, -step))
            row = self.at[:m] + self.lengths[:m] - 1 - step
            after = now[:m]
            kept = after[np.arange(m)[:, None], self.kept[row]] + self.keep_cost[row][wide]
            moved = after[:, TURN] + self.rerole_cost[row][wide]
            now[:m] = with_insertions(np.minimum(np.minimum(kept, moved), after + DELETE))
            np.minimum(now[:m], FAR, out=now[:m])
            before[row] = now[:m]
        return before, now


def with_insertions(costs: np.ndarray) -> np.ndarray:
    """Costs to go (blocks, 4, ...) where turns may be inserted at the place at hand."""
    out = costs.copy()
    out[:, USER] = np.minimum(costs[:, USER], costs[:, ASSISTANT] + INSERT)
    for state in (START, SYSTEM, ASSISTANT):
        out[:, state] = np.minimum(costs[:, state], out[:, USER] + INSERT)
    return out


def last_ends(n: int) -> np.ndarray:
    """Costs at the end of a conversation before insertions there."""
    return np.tile(np.array([0, FAR, FAR, 0]), (n, 1))


def doubled(target: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ranks of the nodes by their whole audits, pointers over 1, 2, 4, ... letters); letter 0 is an end, which points to itself."""
    rank, pointers = letter, [target]
    while True:
        there = pointers[-1]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[there], return_inverse=True)[1]
        if not letter[there].any():
            return rank, pointers
        pointers.append(there[there])


def least_paths(blocks: Blocks, ends: np.ndarray, last: np.ndarray, starts: np.ndarray) -> list[list[tuple[str, int]]]:
    """For every block (in the order of `blocks`) and every state it may start in, the least audit of the cheapest edits and the state
    after them. ends: costs to go at the blocks' ends; last: whether a conversation ends there; starts: how many states are asked for."""
    n = len(blocks.lengths)
    closed = np.where(last[:, None], with_insertions(ends), ends)
    before, _ = blocks.back(closed)
    # Nodes: four for each row and four for each block's end, block by block.
    first = blocks.at + np.arange(n)
    node_of_row = np.arange(len(blocks.codes)) + np.repeat(np.arange(n), blocks.lengths)
    end = first + blocks.lengths
    cost = np.empty((len(blocks.codes) + n, 4), np.int64)
    cost[node_of_row], cost[end] = before, closed
    ids = np.arange(cost.size).reshape(cost.shape)
    arcs = []  # (letter, cost, target), for all nodes

    def arc(letter: str, price, target: np.ndarray, rows: np.ndarray) -> None:
        to, full = ids.copy(), np.full(cost.shape, 2 * FAR)
        to[rows], full[rows] = target, np.minimum(price + cost.reshape(-1)[target], 2 * FAR)
        arcs.append((int(np.flatnonzero(letter == LETTERS)[0]), full == np.minimum(cost, FAR - 1), to))

    arc("D", DELETE, ids[node_of_row + 1], node_of_row)
    places = np.concatenate([node_of_row, end[last]])
    arc("I", INSERT, ids[places][:, TURN], places)
    arc("K", blocks.keep_cost, ids[node_of_row + 1][np.arange(len(node_of_row))[:, None], blocks.kept], node_of_row)
    arc("R", blocks.rerole_cost, ids[node_of_row + 1][:, TURN], node_of_row)

    def chosen(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's optimal arc of the least letter and, among equal ones, the least rank."""
        best = np.full(cost.size, np.iinfo(np.int64).max)
        target, letter = ids.reshape(-1).copy(), np.zeros(cost.size, np.int64)
        for number, optimal, to in arcs:
            to = to.reshape(-1)
            value = np.where(optimal.reshape(-1), number * (cost.size + 1) + rank[to], best)
            better = value < best
            target[better], letter[better], best[better] = to[better], number, value[better]
        return target, letter

    target, letter = chosen(np.zeros(cost.size, np.int64))
    rank, _ = doubled(target, letter)
    target, letter = chosen(rank)
    _, pointers = doubled(target, letter)
    # Lengths of the paths and then the node at every place of every path, by the bits of the place.
    from_block = np.repeat(np.arange(n), starts)
    state = np.arange(len(from_block)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = ids[first[from_block], state]
    length, now = np.zeros(len(at), np.int64), at
    for k in range(len(pointers) - 1, -1, -1):
        there = pointers[k][now]
        on = letter[there] > 0
        length[on] += 1 << k
        now = np.where(on, there, now)
    on = letter[now] > 0
    length[on] += 1
    final = np.where(on, target[now], now)
    places = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    node = np.repeat(at, length)
    for k, pointer in enumerate(pointers):
        node = np.where(places >> k & 1 == 1, pointer[node], node)
    spelled = "".join(LETTERS[letter[node]])
    out, cut = [[] for _ in range(n)], 0
    for b, size, stop in zip(from_block.tolist(), length.tolist(), (final % 4).tolist(), strict=True):
        out[b].append((spelled[cut : cut + size], stop))
        cut += size
    return out


# ---------------------------------------------------------------------------------------------------------------------
# Blocks and borders, as tables


def _costs_of_blocks(blocks: DataFrame) -> DataFrame:
    """key, part, costs (16, from state to state), illegal pairs inside, first and last initial of every block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            own = Blocks([bytes(c) for c in batch["codes"]])
            unit = np.where(np.eye(4, dtype=bool), 0, FAR)
            _, costs = own.back(np.tile(unit, (len(batch), 1, 1)))
            initial = own.codes & 3
            legal = np.isin(initial[:-1] * 4 + initial[1:], [a * 4 + b for a, b in LEGAL_PAIRS])
            inner = np.ones(max(len(initial) - 1, 0), bool)
            inner[(own.at + own.lengths - 1)[:-1]] = False
            illegal = np.concatenate([[0], np.cumsum(inner & ~legal)])
            at, last = own.at, own.at + own.lengths - 1
            out = batch.iloc[own.order][["key", "part"]].reset_index(drop=True)
            out["costs"] = list(costs.reshape(len(batch), 16))
            out["illegal"], out["first"], out["last"] = illegal[last] - illegal[at], initial[at], initial[last]
            yield out

    return blocks.mapInPandas(run, "key string, part int, costs array<long>, illegal long, first long, last long")


def _borders(costs: DataFrame) -> DataFrame:
    """key, part, ends (costs to go at the block's end), is_first, is_last, illegal and cost of the conversation."""
    listed = costs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "costs", "illegal", "first", "last"))).alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, blocks in zip(batch["key"], batch["blocks"], strict=True):
                ends = last_ends(1)[0]
                illegal, later = 0, None
                for i in range(len(blocks) - 1, -1, -1):
                    b = blocks[i]
                    rows.append([key, b["part"], ends, i == 0, i == len(blocks) - 1, 0, 0])
                    to_go = with_insertions(ends[None, :])[0] if later is None else ends
                    illegal += int(b["illegal"]) + (later is not None and (int(b["last"]), later) not in LEGAL_PAIRS)
                    later = int(b["first"])
                    ends = np.minimum((np.asarray(b["costs"]).reshape(4, 4) + to_go[None, :]).min(axis=1), FAR)
                rows[-1][5:] = [illegal, int(ends[START])]
            yield pd.DataFrame(rows, columns=["key", "part", "ends", "is_first", "is_last", "illegal", "cost"])

    return listed.mapInPandas(run, "key string, part int, ends array<long>, is_first boolean, is_last boolean, illegal long, cost long")


def _paths(blocks: DataFrame) -> DataFrame:
    """key, part, and for each state at the block's start the audit and the state at its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            own = Blocks([bytes(c) for c in batch["codes"]])
            batch = batch.iloc[own.order]
            starts = np.where(batch["is_first"].to_numpy(bool), 1, 4)
            found = least_paths(own, np.stack(batch["ends"].to_numpy()), batch["is_last"].to_numpy(bool), starts)
            yield pd.DataFrame({"key": batch["key"].to_numpy(), "part": batch["part"].to_numpy(), "audits": [[a for a, _ in f] for f in found], "stops": [[s for _, s in f] for f in found]})

    return blocks.mapInPandas(run, "key string, part int, audits array<string>, stops array<int>")


def _audits(paths: DataFrame) -> DataFrame:
    """key, part, audit: the path of every block from the state in which the one before it ends."""
    listed = paths.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "stops"))).alias("blocks"))
    begin = F.struct(F.lit(START).alias("state"), F.expr("cast(array() as array<struct<part: int, state: int>>)").alias("done"))
    step = lambda acc, b: F.struct(
        F.element_at(b["stops"], acc["state"] + 1).alias("state"), F.array_append(acc["done"], F.struct(b["part"].alias("part"), acc["state"].alias("state"))).alias("done")
    )
    states = listed.select("key", F.explode(F.aggregate("blocks", begin, step, lambda acc: acc["done"])).alias("at")).select("key", "at.*")
    return paths.join(states, ["key", "part"]).select("key", "part", F.element_at("audits", F.col("state") + 1).alias("audit"))


def _written(rows: DataFrame, audits: DataFrame, parts: int) -> DataFrame:
    """The repaired turns in order: key, place, edit, role, text. Each partition holds whole conversations, of which a task reads one row after the other."""
    heads = audits.select("key", "part", F.lit(-1).cast("long").alias("seq"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("key", "part", "seq", F.lit(None).cast("string").alias("audit"), "role", "text")
    stream = heads.union(texts).repartition(parts, "key").sortWithinPartitions("key", "part", "seq")
    initials = {"s": 0, "u": 1, "a": 2}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, place, audit = None, START, 0, iter("")
        out: list[tuple] = []

        def inserted(edits: Iterator[str]) -> str | None:
            """Write insertions up to the next edit of a turn, and return that edit."""
            nonlocal state, place
            for edit in edits:
                if edit != "I":
                    return edit
                state = int(TURN[state])
                out.append((key, place, "I", ROLES[state], ""))
                place += 1
            return None

        for batch in batches:
            for k, edits, role, text in zip(batch["key"], batch["audit"], batch["role"], batch["text"], strict=True):
                if edits is not None:
                    inserted(audit)
                    if k != key:
                        key, state, place = k, START, 0
                    audit = iter(edits)
                    continue
                edit = inserted(audit)
                if edit == "D":
                    continue
                if edit == "K":
                    state = int(KEPT[initials[role[0]], state])
                else:
                    state = int(TURN[state])
                    role = ROLES[state]
                out.append((key, place, edit, role, text))
                place += 1
            yield pd.DataFrame(out, columns=["key", "place", "edit", "role", "text"])
            out.clear()
        inserted(audit)
        yield pd.DataFrame(out, columns=["key", "place", "edit", "role", "text"])

    return stream.mapInPandas(run, "key string, place long, edit string, role string, text string")


def _digests(turns: DataFrame) -> DataFrame:
    """key and the hash of `role:text` lines, of turns as `_written` gives them, in the same pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for batch in batches:
            done = []
            for k, role, text in zip(batch["key"], batch["role"], batch["text"], strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(done, columns=["key", "repaired_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "repaired_sha256"])

    return turns.mapInPandas(run, "key string, repaired_sha256 string")


@dataclass(frozen=True)
class Repaired:
    """turns: key, place, edit, role, text of the repaired conversations; summary: a row for each conversation that has turns;
    keys: key and conv_id of each."""

    turns: DataFrame
    summary: DataFrame
    keys: DataFrame


def repair(turns: DataFrame) -> Repaired:
    """The cheapest repair of conversations given by conv_id, turn, role and text (none of the last two NULL).

    Turns are taken by number, NULL first; turns of one number by role, then by text (its first 64 characters, then its digest); equal
    rows are duplicates. Blank and duplicate turns are deleted, whatever their role. A role counts by its first letter; an empty role
    or another letter can't be kept. A NULL conv_id is one conversation. An empty table gives empty results. Long texts are read once.
    """
    scratch = Scratch(turns.sparkSession, "conversations", turns)
    rows = in_order(turns, scratch)
    marked = scratch.save(faults(rows), few=True)
    by_turn = marked.groupBy("key", "turn").agg(*[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    width = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count("turn").cast("decimal(20,0)")
    counts = by_turn.groupBy("key").agg(F.coalesce(width, F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    codes = F.transform(F.sort_array(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"])
    blocks = marked.groupBy("key", "part").agg(codes.alias("codes"))
    # One byte for each turn.
    blocks = scratch.save(blocks.withColumn("codes", F.unhex(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))), few=True)
    borders = scratch.save(_borders(_costs_of_blocks(blocks)), few=True)
    paths = scratch.save(_paths(blocks.join(borders.drop("illegal", "cost"), ["key", "part"])), few=True)
    audits = scratch.save(_audits(paths), few=True)
    whole = audits.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    summary = counts.join(borders.where("is_first").select("key", "illegal", "cost"), "key").join(whole, "key")
    keys = rows.select("key", "conv_id").distinct()
    return Repaired(_written(rows, audits, shuffle_parts(turns)), summary, keys)


def repair_report(turns: DataFrame, names: Names = Names()) -> DataFrame:
    """For every conversation of the table, damaged by `damaged` and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. A conversation without turns after the damage has zeros, an empty audit and the hash of nothing."""
    repaired = repair(damaged(turns, names))
    found = repaired.summary.join(_digests(repaired.turns), "key", "left")
    every = turns.select(F.col(f"`{names.conversation}`").alias("conv_id")).distinct().withColumn("key", key_of("conv_id"))
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing = hashlib.sha256().hexdigest()
    out = every.join(found, "key", "left").withColumns(zeros)
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))

"""Packing documents into sequences of a fixed number of tokens by a grouping genetic algorithm.

Documents are encoded and cut into pieces. Pieces of full length are sequences as they are; the others are dealt evenly over shards
of a few thousand pieces. Each shard is evolved on several islands, each a row of its own with a population of packings: a child takes
whole well-filled sequences from one parent, loses the sequences of the other parent that hold the same pieces, and the pieces
displaced by that are put where they fit best. After every epoch an island's best packing migrates to the next island of its shard,
in place of the worst there. The best packing of a shard's islands stands; what its badly filled sequences hold is dealt and
evolved anew with that of other shards, until one shard is left or that saves less than half a percent of its sequences.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch, has_rows, shuffle_parts
from tablewright.llm.token_counts import TokenizerFile


@dataclass(frozen=True)
class Packing:
    """limit: tokens of a sequence; end: the id after each document; shard: pieces evolved together; settled: hundredths of the
    limit from which a sequence is no longer taken apart."""

    limit: int = 1024
    end: int = 2
    shard: int = 4096
    islands: int = 3
    epochs: int = 2
    population: int = 6
    children: int = 12  # of an island in an epoch
    settled: int = 98


# ---------------------------------------------------------------------------------------------------------------------
# Pieces


#: Characters that every Unicode version puts into the same class. A text of these alone is split alike by all libraries.
_SETTLED = re.compile(r"[^\n -~¡-ɏ‐-‧‰-⁞€]")
_SEGMENT = 1 << 20


def _segments(text: str) -> Iterator[str]:
    """A long text in parts of about a megabyte. It is cut before a space that follows a plain character, as no token of a byte-level
    tokenizer with the usual pattern goes on from there into white space."""
    start, at = 0, _SEGMENT
    while len(text) - start > _SEGMENT:
        at = text.find(" ", at)
        if at < 0:
            break
        if "!" <= text[at - 1] <= "~" or "¡" <= text[at - 1] <= "ɏ":
            yield text[start:at]
            start, at = at, at + _SEGMENT
        else:
            at += 1
    yield text[start:]


class Encoder:
    """Token ids of texts as the tokenizers library gives them, as bytes of little-endian 32-bit numbers.

    Where the file is a byte-level tokenizer with the usual pattern whose merges stand in the order of their ids, texts of plain
    characters go through tiktoken with the same vocabulary, which gives the same ids in a quarter of the time; other texts,
    among them those with a special token, and other files go through the library itself.
    """

    def __init__(self, data: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(data)
        self.special = [t["content"] for t in made.get("added_tokens") or []]
        own = made.get("pre_tokenizer") or {}
        usual = own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space") and not made.get("normalizer")
        self.cuts = usual and not any(" " in t or "\n" in t for t in self.special)
        self.fast = self._same_in_tiktoken(made["model"]) if usual else None

    def _same_in_tiktoken(self, model: dict):
        """tiktoken's encoder of the vocabulary; None if the model is of another kind."""
        vocabulary = {t: i for t, i in model.get("vocab", {}).items() if t not in self.special}
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        made = [vocabulary.get("".join(m.split(" ", 1) if isinstance(m, str) else m)) for m in model["merges"]]
        if None in made or any(a >= b for a, b in pairwise(made)):
            return None
        import tiktoken

        # A byte is written as the character of its number where that can be seen, else as one of those from 256 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in seen]
        byte_of = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
        return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={_NEVER: 1 << 30})

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            whole = b""
            for part in _segments(text) if self.cuts else [text]:
                if self.fast and not _SETTLED.search(part) and not any(t in part for t in self.special):
                    whole += self.fast.encode_to_numpy(part, disallowed_special=()).astype("<u4", copy=False).tobytes()
                else:
                    whole += np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
            out.append(whole)
        return out


#: tiktoken looks for special tokens where it gives ids as an array, so it gets one, which no text of plain characters holds.
_NEVER = "\0\0"

#: Fixed value: how byte-level tokenizers split a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def _encoder(data: bytes) -> Encoder:
    """One for each Python process, whatever number of tasks it runs."""
    return Encoder(data.decode())


def pieces(docs: DataFrame, tokenizer: TokenizerFile, packing: Packing = Packing(), id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every row of docs.

    Only a document longer than the limit is cut; its first piece takes what whole pieces leave over. A NULL text is empty, and an
    empty text has the end id alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer.data)
        end = np.array([packing.end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                rows = []
                for doc_id, ids in zip(part["doc_id"].tolist(), encoder.encode([t or "" for t in part["text"]]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    start, piece = 0, 0
                    stop = (n - 1) % packing.limit + 1
                    while start < n:
                        own = ids[4 * start : 4 * stop]
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else [])))
                        start, stop, piece = stop, stop + packing.limit, piece + 1
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    # Ids go as text, so that a missing one among them costs the others no digits.
    source = docs.select(F.col(f"`{id_column}`").cast("long").cast("string").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    found = source.mapInPandas(run, f"doc_id string, piece int, start long, length long, ids_crc32 long{', ids array<int>' if with_ids else ''}")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


# ---------------------------------------------------------------------------------------------------------------------
# Evolution of a shard


Bins = list[list[int]]


class Shard:
    """Packings of a shard's pieces: lists of bins, each a list of places in `lengths`."""

    def __init__(self, lengths: list[int], limit: int, rng: np.random.Generator):
        self.lengths, self.limit, self.rng = lengths, limit, rng
        self.least = -(-sum(lengths) // limit)

    def fill(self, members: list[int]) -> int:
        lengths = self.lengths
        return sum([lengths[i] for i in members])

    def score(self, bins: Bins) -> tuple[int, int]:
        """Few bins first, then bins as unequally filled as can be: the larger the better."""
        return -len(bins), sum([self.fill(b) ** 2 for b in bins])

    def best_fit(self, bins: Bins, items: list[int]) -> Bins:
        """bins with the items put, one after the other, into the fullest bin that has room; bins are changed in place."""
        lengths, limit = self.lengths, self.limit
        by_room: dict[int, list[int]] = {}
        rooms = 0
        for number, members in enumerate(bins):
            room = limit - self.fill(members)
            if room:
                by_room.setdefault(room, []).append(number)
                rooms |= 1 << room
        for item in items:
            size = lengths[item]
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                number = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
                bins[number].append(item)
            else:
                number, room = len(bins), limit
                bins.append([item])
            room -= size
            if room:
                by_room.setdefault(room, []).append(number)
                rooms |= 1 << room
        return bins

    def longest_first(self, items: list[int], noise: float = 0.0) -> list[int]:
        lengths = self.lengths
        if noise:
            moved = self.rng.uniform(1 - noise, 1 + noise, len(items))
            return [i for _, i in sorted(zip([-lengths[i] * m for i, m in zip(items, moved.tolist(), strict=True)], items, strict=True))]
        return sorted(items, key=lambda i: -lengths[i])

    def founders(self, n: int) -> list[Bins]:
        """Best fit, the longest first, and the same in slightly different orders."""
        items = list(range(len(self.lengths)))
        return [self.best_fit([], self.longest_first(items, 0.15 * k)) for k in range(n)]

    def child(self, giver: Bins, taker: Bins) -> Bins:
        """A child of two packings: half of the giver's better filled bins, then the taker's bins that share no piece with them; the
        two least filled bins of the rest are dissolved as well."""
        fills = np.array([self.fill(b) for b in giver])
        good = np.flatnonzero(fills >= np.median(fills))
        good = good[self.rng.random(len(good)) < 0.5]
        own = [giver[i] for i in good.tolist()]
        taken = {i for b in own for i in b}
        kept, displaced = [], []
        for members in taker:
            if taken.isdisjoint(members):
                kept.append(members)
            else:
                displaced.extend([i for i in members if i not in taken])
        kept.sort(key=self.fill)
        for members in kept[:2]:
            displaced.extend(members)
        bins = [list(b) for b in [*own, *kept[2:]]]
        return self.best_fit(bins, self.longest_first(displaced, 0.1 * self.rng.random()))

    def evolve(self, population: list[Bins], children: int) -> list[Bins]:
        """The population after some children, each in place of the worst where it is better; the best first."""
        scored = sorted(((self.score(b), k, b) for k, b in enumerate(population)), key=lambda x: x[:2], reverse=True)
        for turn in range(children):
            if len(scored[0][2]) <= self.least or len(scored) < 2:
                break  # no packing has fewer bins
            # The better of two drawn, twice.
            a, b = (min(self.rng.integers(0, len(scored), 2).tolist()) for _ in "ab")
            new = self.child(scored[a][2], scored[b if a != b else (a + 1) % len(scored)][2])
            value = self.score(new)
            if value > scored[-1][0]:
                scored[-1] = (value, len(population) + turn, new)
                scored.sort(key=lambda x: x[:2], reverse=True)
        return [b for _, _, b in scored]


def as_numbers(bins: Bins, n: int) -> bytes:
    """The bin of each piece."""
    out = np.empty(n, "<u4")
    for number, members in enumerate(bins):
        out[members] = number
    return out.tobytes()


def as_bins(numbers: bytes) -> Bins:
    own = np.frombuffer(numbers, "<u4").astype(np.int64)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    return [b.tolist() for b in np.split(order, cuts)] if len(own) else []


def _evolved(islands: DataFrame, packing: Packing, epoch: int) -> DataFrame:
    """shard, island, population (the best first) after an epoch; islands: shard, island, lengths, population (empty at first), migrant."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for shard, island, lengths, population, migrant in batch[["shard", "island", "lengths", "population", "migrant"]].itertuples(index=False):
                own = Shard(lengths.tolist(), packing.limit, np.random.default_rng([int(shard), int(island), epoch]))
                if len(population):
                    bins = [as_bins(p) for p in population]
                    if migrant is not None:
                        bins[-1] = as_bins(migrant)
                else:
                    bins = own.founders(packing.population)
                bins = own.evolve(bins, packing.children)
                rows.append((shard, island, len(bins[0]), own.score(bins[0])[1], [as_numbers(b, len(lengths)) for b in bins]))
            yield pd.DataFrame(rows, columns=["shard", "island", "n_bins", "filled", "population"])

    return islands.mapInPandas(run, "shard long, island int, n_bins long, filled long, population array<binary>")


def _level(scratch: Scratch, items: DataFrame, n: int, level: int, packing: Packing) -> DataFrame:
    """item, length, sequence_id, offset, open of the items (item, length), packed shard by shard."""
    shards = -(-n // packing.shard)
    dealt = items.groupBy(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("own"))
    dealt = scratch.save(dealt.select("shard", F.col("own.item").alias("items"), F.col("own.length").alias("lengths")), few=True)
    parts = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(shards * packing.islands // 4, 100_000))
    every = dealt.select("shard", "lengths", F.explode(F.sequence(F.lit(0), F.lit(packing.islands - 1))).alias("island"))
    nothing = F.expr("cast(array() as array<binary>)")
    state = None
    for epoch in range(packing.epochs):
        if state is None:
            now = every.withColumns({"population": nothing, "migrant": F.lit(None).cast("binary")})
        else:
            best = state.select("shard", F.pmod(F.col("island") + 1, F.lit(packing.islands)).alias("island"), F.col("population")[0].alias("migrant"))
            now = every.join(state.select("shard", "island", "population"), ["shard", "island"]).join(best, ["shard", "island"])
        now = now.select("shard", "island", "lengths", "population", "migrant").repartition(parts, "shard", "island")
        state = scratch.save(_evolved(now, packing, epoch))
    winner = state.groupBy("shard").agg(F.max_by(F.col("population")[0], F.struct(-F.col("n_bins"), "filled", -F.col("island"))).alias("bins"))
    least = packing.limit * packing.settled

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, items, lengths, numbers in batch[["shard", "items", "lengths", "bins"]].itertuples(index=False):
                own = np.frombuffer(numbers, "<u4").astype(np.int64)
                order = np.argsort(own, kind="stable")
                size = np.asarray(lengths)[order]
                before = np.cumsum(size) - size
                fills = np.bincount(own, lengths)
                first = np.concatenate([[0], np.cumsum(np.bincount(own))[:-1]])
                own = own[order]
                yield pd.DataFrame(
                    {
                        "item": np.asarray(items)[order],
                        "length": size,
                        "sequence_id": (level << 56) + (int(shard) << 24) + own,
                        "offset": before - before[first[own]],
                        "open": 100 * fills[own] < least,
                    }
                )

    packed = dealt.join(winner, "shard").mapInPandas(run, "item long, length long, sequence_id long, offset long, open boolean")
    return scratch.save(packed, few=True)


def packed(docs: DataFrame, tokenizer: TokenizerFile, packing: Packing = Packing(), id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece.

    Each row of docs is a document, also where ids are missing or repeated. A NULL text is empty; an empty text is its end id. A long
    text is cut; pieces of full length stand alone. Ties are settled by fixed seeds, so equal input, read in equal partitions, is
    packed equally. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing", docs)
    found = pieces(docs, tokenizer, packing, id_column, text_column, with_ids).withColumn("item", F.monotonically_increasing_id())
    found = scratch.save(found)
    items, placed, level, before = found.where(F.col("length") < packing.limit).select("item", "length"), None, 0, None
    while has_rows(items):
        n = items.count()
        done = _level(scratch, items, n, level, packing)
        by_sequence = done.groupBy("sequence_id").agg(F.max("open").alias("open"))
        made, still_open = by_sequence.agg(F.count("*"), F.count_if("open")).first()
        # The last shard, or dealing anew has saved next to nothing.
        last = n <= packing.shard or not still_open or (before is not None and 1000 * made > 995 * before)
        kept = done if last else done.where("not open")
        placed = kept if placed is None else placed.union(kept)
        if last:
            break
        items, level, before = scratch.save(done.where("open").select("item", "length"), few=True), level + 1, still_open
    own = -F.col("item") - 1  # full pieces are sequences of their own
    if placed is None:
        return found.withColumns({"sequence_id": own, "offset": F.lit(0).cast("long")}).drop("item")
    out = found.join(placed.select("item", "sequence_id", "offset"), "item", "left")
    return out.withColumns({"sequence_id": F.coalesce("sequence_id", own), "offset": F.coalesce("offset", F.lit(0).cast("long"))}).drop("item")


def sequences(docs: DataFrame, tokenizer: TokenizerFile, packing: Packing = Packing(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What training reads: sequence_id, ids (at most `limit`), and doc_ids and lengths of the pieces in them, in order."""
    rows = packed(docs, tokenizer, packing, id_column, text_column, with_ids=True)
    grouped = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("own"))
    return grouped.select("sequence_id", F.flatten("own.ids").alias("ids"), F.col("own.doc_id").alias("doc_ids"), F.col("own.length").alias("lengths"))

"""Benchmark decontamination by spaced seeds, in DataFrame and SQL functions only.

A seed is the hash of the words at a few fixed places of a span; the words between them do not matter, so seeds survive
substitutions. Seeds at all places of all texts are joined with those of the benchmark, and around every hit the item's words are laid
against the text's: an item is leaked if some window of it agrees in most words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import LAST_ID, Scratch, row_id, shuffle_parts, text_key
from tablewright.llm.native import NO_LETTERS, hashes, let, lowered, text_of, upto, words


@dataclass(frozen=True)
class Decontamination:
    """Settings. The masks name the places of a span that a seed reads. Whatever a whole window accepts, one of `masks` hits; items
    shorter than a window need the short masks as well, and items shorter than the span masks of their own."""

    masks: tuple[tuple[int, ...], ...] = ((0, 1, 3, 4, 7), (0, 2, 3, 6, 7), (0, 1, 2, 3, 4))
    short_masks: tuple[tuple[int, ...], ...] = ((0, 1, 3, 5, 6),)
    window: int = 13  # words of an item (or all, of a shorter one) that are laid against the text at once
    least_equal: int = 80  # hundredths of the window's words that must agree
    buckets: int = 1 << 20  # of the filter that goes to every task, at most one row each


def masks_of(n: int, settings: Decontamination) -> tuple[tuple[int, ...], ...]:
    """The masks for items of n words, of which one hits every alignment that is accepted."""
    if n >= settings.window:
        return settings.masks
    if n > max(max(m) for m in settings.masks):
        return settings.masks + settings.short_masks
    # All words but as many as may differ.
    return tuple(combinations(range(n), -(-settings.least_equal * n // 100)))


def seeds(hashed: DataFrame, masks: Iterable[tuple[int, ...]]) -> DataFrame:
    """(id, at, seed): the seeds of the masks at all places of texts given as id and w (hashed words)."""

    def of(mask: tuple[int, ...]):
        def seed(i):
            return F.xxhash64(F.lit(",".join(map(str, mask))), *[F.get("w", i + o) for o in mask])

        # Every mask gives as many elements as there are words, so that an element's place is known from its number.
        return F.transform(upto(F.size("w") - 1), lambda i: F.when(i < F.size("w") - max(mask), seed(i)))

    every = hashed.select("id", F.greatest(F.size("w"), F.lit(1)).alias("n"), F.concat(*[of(m) for m in masks]).alias("seeds"))
    # An outer explode: of an inner one Spark asks beforehand whether it has rows, and would split the text again for every word.
    every = every.select("id", "n", F.posexplode_outer("seeds").alias("at", "seed")).where("seed is not null")
    return every.select("id", (F.col("at") % F.col("n")).alias("at"), "seed")


def hashed_words(rows: DataFrame) -> DataFrame:
    """(id, w) of texts given as id and text."""
    return rows.select("id", lowered(text_of("text")).alias("text")).select("id", hashes(words(F.col("text"), NO_LETTERS)).alias("w"))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    settings: Decontamination = Decontamination(),
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    keyed: bool = False,
) -> DataFrame:
    """(doc_id, item_id, n_equal, n_item, best, window, first_word) of every document that holds most of some window of an item.

    n_equal: item words that agree in the best alignment; best: of the best window; first_word: where that alignment starts in the text
    (negative if the item begins before it). With keyed=True also text_key, which tells documents of one id apart. Items of any
    number of words are found, be it one; empty texts match nothing. A missing id is NULL in the result. Equal rows
    (id and text) are one document; different texts under one id, or without any, are documents of their own.
    """
    scratch = Scratch(docs.sparkSession, "leaks", docs)
    items = scratch.save(hashed_words(benchmark.select(row_id(f"`{item_column}`").alias("id"), F.col(f"`{item_text_column}`").alias("text"))).dropDuplicates(), few=True)
    # Rows that share an item id are one item under that id, each with its own words.
    items = items.withColumn("item", F.xxhash64("id", "w")).withColumnRenamed("id", "item_id")
    # Items of one set of masks together; texts need only the masks that some item has, and a window is the most words that matter.
    lengths = items.select(F.least(F.size("w"), F.lit(settings.window)).alias("n")).where("n > 0").distinct().collect()
    groups = defaultdict(list)
    for r in sorted(lengths):
        groups[masks_of(r["n"], settings)].append(r["n"])
    groups = groups or {settings.masks: [settings.window]}
    sized = items.select(F.col("item").alias("id"), "w", F.least(F.size("w"), F.lit(settings.window)).alias("n"))
    known = reduce(DataFrame.union, [seeds(sized.where(F.col("n").isin(of)).select("id", "w"), masks) for masks, of in groups.items()])
    known = known.select(F.col("id").alias("item"), F.col("at").alias("place"), "seed")
    bucket = F.pmod(F.col("seed"), F.lit(settings.buckets))
    occupied = known.select(bucket.alias("bucket")).distinct()
    key = F.struct(row_id(f"`{id_column}`").alias("doc_id"), text_key(f"`{text_column}`").alias("text_key")).alias("id")
    own = docs.select(key, F.col(f"`{text_column}`").alias("text"))
    found = seeds(hashed_words(own), dict.fromkeys(m for masks in groups for m in masks)).withColumn("bucket", bucket).join(F.broadcast(occupied), "bucket", "left_semi")
    hits = found.join(known, "seed").select("id", "item", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    sizes = items.select("item", F.size("w").alias("n_item"))
    hits = hits.join(sizes, "item").groupBy("id").agg(F.collect_list(F.struct("item", "n_item", "diagonal")).alias("hits"))
    hits = scratch.save(hits, few=True)

    parts = shuffle_parts(docs, 8 << 20)
    near = own.repartition(parts, "id").join(hits.repartition(parts, "id").hint("shuffle_hash"), "id")

    def aligned(w):
        def at(h):
            there = F.transform(upto(h["n_item"] - 1), lambda j: F.get(w, h["diagonal"] + j))
            return F.struct(h["item"].alias("item"), h["diagonal"].alias("diagonal"), there.alias("there"))

        return F.transform("hits", at)

    # `let` makes the words of a text once for all of its hits.
    laid = near.select("id", F.explode_outer(let(hashes(words(lowered(text_of("text")), NO_LETTERS)), aligned)).alias("x"))
    laid = laid.select("id", "x.item", "x.diagonal", "x.there").join(items, "item")
    equal = F.transform("w", lambda h, j: F.coalesce((F.get("there", j) == h).cast("int"), F.lit(0)))
    laid = laid.select("id", "item_id", "diagonal", F.size("w").alias("n_item"), F.least(F.size("w"), F.lit(settings.window)).alias("window"), equal.alias("equal"))
    total = F.aggregate("equal", F.lit(0), lambda a, x: a + x)
    windows = F.transform(upto(F.size("equal") - F.col("window")), lambda i: F.aggregate(F.slice("equal", i + 1, F.col("window")), F.lit(0), lambda a, x: a + x))
    laid = laid.withColumns({"n_equal": total, "best": F.array_max(windows)})
    laid = laid.where(F.col("best") * 100 >= F.col("window") * settings.least_equal)
    best = F.max(F.struct("n_equal", "best", (-F.col("diagonal")).alias("back"), "n_item", "window")).alias("b")
    out = laid.groupBy("id", "item_id").agg(best)
    return out.select(
        F.when(F.col("id.doc_id") != LAST_ID, F.col("id.doc_id")).alias("doc_id"),
        F.when(F.col("item_id") != LAST_ID, F.col("item_id")).alias("item_id"),
        *[F.col(f"b.{c}").cast("long").alias(c) for c in ("n_equal", "n_item", "best", "window")],
        (-F.col("b.back")).cast("long").alias("first_word"),
        *([F.col("id.text_key").alias("text_key")] if keyed else []),
    )

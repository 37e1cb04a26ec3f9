"""Mixing sources to target weights.

Weights are the sources' token shares raised to an exponent between 0 (all equal) and 1 (as they are). The exponent is found by
narrowing its interval: the largest whose weights reach the target entropy, but none that would repeat a source more often than
allowed. Each source then gets its weight's part of the token budget: whole passes over its documents, and of one more pass, in
an order given by a hash, as many documents as the rest of its budget holds. That order is cut by blocks: block
totals are summed up first and only the block with the cut is looked at by document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch
from tablewright.llm.native import SPACES, text_of, words


@dataclass(frozen=True)
class Mixture:
    """entropy: target, as a share of the entropy of equal weights; budget: tokens, as a multiple of those there are."""

    entropy: float = 0.97
    most_passes: float = 4.0
    budget: float = 1.0
    seed: str = "mix"
    points: int = 64  # that an interval is divided into
    turns: int = 4  # of narrowing


def row_name(id_column: str, text_column: str) -> Column:
    """What a document's place depends on: its id, or without one a digest of its text."""
    return F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit(":"), F.md5(text_of(text_column).cast("binary"))))


def order_key(mixture: Mixture, id_column: str, text_column: str) -> Column:
    """A document's place in its source's permutation; the first three digits are its block."""
    return F.md5(F.concat(F.lit(f"{mixture.seed}:"), row_name(id_column, text_column)).cast("binary"))


def exponent(totals: DataFrame, mixture: Mixture) -> float:
    """The exponent for sources with their tokens; each turn evaluates points of the interval in one aggregate over the sources."""
    whole = totals.agg(F.sum("tokens").alias("t"), F.sum((F.col("tokens") > 0).cast("int")).alias("n")).first()
    if not whole["t"] or whole["n"] < 2:
        return 1.0
    shares = totals.where("tokens > 0").select((F.col("tokens") / F.lit(float(whole["t"]))).alias("p"))

    def narrowed(fits) -> float:
        """The end of the last interval at which `fits` turns."""
        low, high = 0.0, 1.0
        for _ in range(mixture.turns):
            step = (high - low) / mixture.points
            points = F.explode(F.sequence(F.lit(0), F.lit(mixture.points))).alias("i")
            at = shares.select("p", points).withColumn("a", F.lit(low) + F.col("i") * F.lit(step))
            sums = at.groupBy("i").agg(
                F.sum(F.pow("p", F.col("a"))).alias("z"),
                F.sum(F.pow("p", F.col("a")) * F.col("a") * F.log("p")).alias("w"),
                F.max(F.pow("p", F.col("a") - 1)).alias("top"),
            )
            # Entropy of p**a / z, and the passes over the source that is repeated most.
            rows = sums.select("i", (F.log("z") - F.col("w") / F.col("z")).alias("h"), (F.col("top") / F.col("z") * mixture.budget).alias("passes")).collect()
            low += max([r["i"] for r in rows if fits(r)], default=0) * step
            high = min(low + step, 1.0)
        return low

    target = mixture.entropy * math.log(whole["n"])
    by_entropy = narrowed(lambda r: r["h"] >= target)
    too_often = narrowed(lambda r: r["passes"] > mixture.most_passes)
    return max(by_entropy, too_often)


def mix_sources(docs: DataFrame, mixture: Mixture = Mixture(), id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """docs with n_tokens (words), copy (0, 1, ...) and shuffle_key added, a row for each copy; the new columns take the place of
    columns of those names. Training reads by copy and shuffle_key.

    A NULL source is a source. A NULL text has no tokens; documents without tokens cost nothing and come once. Rows with one id, and
    equal texts without an id, have one place in the order and are taken or left together. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing", docs)
    tokens = F.size(words(text_of(f"`{text_column}`"), SPACES)).cast("long")
    source = F.coalesce(F.col(f"`{source_column}`").cast("string"), F.lit("\0"))
    rows = scratch.save(docs.select(source.alias("s"), order_key(mixture, f"`{id_column}`", f"`{text_column}`").alias("k"), tokens.alias("n")))
    blocks = scratch.save(rows.groupBy("s", F.substring("k", 1, 3).alias("b")).agg(F.sum("n").alias("n")), few=True)
    totals = scratch.save(blocks.groupBy("s").agg(F.sum("n").alias("tokens")), few=True)
    a = exponent(totals, mixture)
    whole = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.sum(F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a)))).alias("z")).first()
    # Weights in billionths, so that budgets are products of whole numbers.
    share = F.when(F.col("tokens") > 0, F.floor(F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(float(whole["z"] or 1.0)) * 1e9)).otherwise(0)
    plan = totals.withColumn("share", share.cast("decimal(12,0)"))
    product = F.col("share") * F.lit(int(whole["t"] * mixture.budget)).cast("decimal(20,0)")
    plan = plan.select("s", "tokens", F.floor(product / F.lit(10**9)).cast("long").alias("budget"))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.withColumn("passes", passes).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
    # At most 4096 blocks for each source.
    summed = blocks.join(plan, "s").withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("b")))
    cut = summed.groupBy("s", "passes", "rest").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("b", (F.col("upto") - F.col("n")).alias("before")))).alias("cut"))
    cut = scratch.save(cut.select("s", "passes", "rest", F.col("cut.b").alias("b"), F.col("cut.before").alias("before")), few=True)
    inside = rows.withColumn("b", F.substring("k", 1, 3)).join(cut.where("b is not null"), ["s", "b"])
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("s").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)))
    last = inside.where("upto <= rest").groupBy("s").agg(F.max("k").alias("last"))
    # The end of the extra pass: the last document taken; without one in the cut block, all blocks before; without a cut, everything.
    ends = scratch.save(cut.join(last, "s", "left").select("s", "passes", F.coalesce("last", "b", F.lit("g")).alias("end")), few=True)
    added = ["n_tokens", "copy", "shuffle_key"]
    wide = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], source.alias("__s"), order_key(mixture, f"`{id_column}`", f"`{text_column}`").alias("__k"), tokens.alias("n_tokens"))
    wide = wide.join(ends.select(F.col("s").alias("__s"), F.col("passes").alias("__passes"), F.col("end").alias("__end")), "__s")
    copies = F.col("__passes") + (F.col("__k") <= F.col("__end")).cast("long")
    wide = wide.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies))).where(F.col("copy") < copies)
    key = F.md5(F.concat_ws(":", F.lit(mixture.seed), F.col("copy").cast("string"), row_name(f"`{id_column}`", f"`{text_column}`")).cast("binary"))
    return wide.withColumn("shuffle_key", key).drop("__s", "__k", "__passes", "__end")

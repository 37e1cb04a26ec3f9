"""Near duplicates by SetSketch registers.

Every document is the set of its word shingles. A register is the smallest of the set's exponentially distributed hashes, kept
only as a step on an exponential scale: the sketch of a union is the larger step of each register, and registers agree the more
often the more alike two sets are. Bands of registers propose pairs, a likelihood over all registers drops the pairs that can't
be alike enough, and the whole sets of the rest are compared.

No pairs of a group are multiplied out. Documents with equal sets are one class from the start. Each band's bucket ties its
members to its first member, its hub. What no hub's links have joined is looked at hub by hub: first by registers alone, which leaves
the few documents that may still be linked to another component of their buckets, then by the whole sets of those few. Neither
look emits pairs: the first gives documents, the second links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import LAST_ID, Scratch, components, encoded, has_rows, in_batches, mix, row_id, shingle_sets, shuffle_parts, text_key


@dataclass(frozen=True)
class NearDuplicates:
    """Settings. With 40 bands of 5 registers a pair of similarity 0.8 is missed with a probability below 1e-6."""

    shingle: int = 5
    percent: int = 80  # least similarity, in hundredths
    bands: int = 40
    rows: int = 5
    base: float = 1.02  # of the exponential scale
    register_block: int = 4096  # documents that a task compares by registers at a time, where the rest of a bucket is looked at
    text_block: int = 512  # and by whole sets

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def sketch(hashes: np.ndarray, settings: NearDuplicates) -> np.ndarray:
    """The registers of a set of 64-bit hashes: steps of the smallest exponential of each register."""
    factors = mix(np.arange(1, settings.registers + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(settings.registers, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * factors).min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(settings.base)), 0, 65535).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float) -> np.ndarray:
    """The likeliest similarity of pairs of sets, from how many registers are larger, smaller and equal, and the set sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 65)[None, :] * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (base - 1) / base) / np.log(base)

    p_more, p_less = (np.clip(p(x), 1e-12, 1) for x in (u - v * j, v - u * j))
    p_same = np.clip(1 - p_more - p_less, 1e-12, 1)
    likelihood = more * np.log(p_more) + less * np.log(p_less) + same * np.log(p_same)
    return np.take_along_axis(j, likelihood.argmax(axis=1)[:, None], axis=1)[:, 0]


def sketches(docs: DataFrame, settings: NearDuplicates, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest of the set, registers) of every row; no registers for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [encoded(t) for t in batch["text"]]
            for part in in_batches(texts):
                sets = shingle_sets(texts[part], settings.shingle)
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[part].to_numpy(),
                        "text_key": batch["text_key"].iloc[part].to_numpy(),
                        "n_shingles": [len(s) for s in sets],
                        "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                        "registers": [sketch(s, settings).tobytes() if len(s) else None for s in sets],
                    }
                )

    source = docs.select(row_id(id_column).alias("doc_id"), text_key(text_column).alias("text_key"), F.col(text_column).cast("string").alias("text"))
    return source.mapInPandas(run, "doc_id long, text_key long, n_shingles long, digest binary, registers binary")


def band_keys(classes: DataFrame, settings: NearDuplicates) -> DataFrame:
    """(key, doc_id): a row for each band of each document; documents whose band registers agree share the key."""
    factors = mix(np.arange(1, settings.registers + 1, dtype=np.uint64)).reshape(settings.bands, settings.rows) | np.uint64(1)
    salts = mix(np.arange(1000, 1000 + settings.bands, dtype=np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            registers = np.frombuffer(b"".join(batch["registers"]), np.uint16).reshape(len(batch), settings.bands, settings.rows)
            keys = mix((registers.astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64) + salts)
            yield pd.DataFrame({"key": keys.view(np.int64).ravel(), "doc_id": np.repeat(batch["doc_id"].to_numpy(), settings.bands)})

    return classes.select("doc_id", "registers").mapInPandas(run, "key long, doc_id long")


def promising(pairs: DataFrame, classes: DataFrame, settings: NearDuplicates) -> DataFrame:
    """Pairs (a, b) that are not ruled out by their sizes and registers; six standard deviations are allowed for."""
    least = settings.percent / 100
    least -= 6 * np.sqrt(least * (1 - least) / settings.registers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                a, b = (np.frombuffer(b"".join(part[c]), np.uint16).reshape(len(part), -1) for c in ("a_registers", "b_registers"))
                n_a, n_b = (part[c].to_numpy(np.float64) for c in ("a_n", "b_n"))
                yield part.loc[estimate(a, b, n_a, n_b, settings.base) >= least, ["a", "b"]]

    sides = [classes.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"{s}_n"), F.col("registers").alias(f"{s}_registers")) for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    joined = joined.where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * settings.percent)
    return joined.mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, settings: NearDuplicates) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a_texts, b_texts = ([encoded(t) for t in batch[f"{c}_text"]] for c in "ab")
            keep = np.zeros(len(batch), bool)
            for part in in_batches([a + b for a, b in zip(a_texts, b_texts, strict=True)]):
                a_sets, b_sets = shingle_sets(a_texts[part], settings.shingle), shingle_sets(b_texts[part], settings.shingle)
                common = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(a_sets, b_sets, strict=True)]
                keep[part] = [100 * c >= settings.percent * (len(a) + len(b) - c) for a, b, c in zip(a_sets, b_sets, common, strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    sides = [texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"{s}_text")) for s in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, settings: NearDuplicates = NearDuplicates(), id_column: str = "doc_id", text_column: str = "text", keyed: bool = False
) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept; with keyed=True also text_key, which tells rows of one id apart.

    component_id is the smallest id reachable over links; documents without a word stand alone. A missing id counts as
    the largest of all and comes back as NULL. Equal rows (id and text) are one document and give repeated results; different texts
    under one id, or without any, are documents of their own, in the order of text_key, and the first of a component is kept.
    A NULL text is empty. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates", docs)
    parts = shuffle_parts(docs)
    rows = scratch.save(sketches(docs, settings, id_column, text_column))
    full = rows.where("n_shingles > 0")
    # One document stands for all with the same set. Classes go by numbers of their own in what follows, as ids need not be unique.
    first = full.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("digest", "first.*")
    classes = full.join(first, ["digest", "doc_id", "text_key"]).dropDuplicates(["digest"])
    classes = classes.select("digest", F.struct("doc_id", "text_key").alias("first"), "n_shingles", "registers", F.monotonically_increasing_id().alias("doc_id"))
    classes = scratch.save(classes)
    keys = band_keys(classes, settings).repartition(parts, "key")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("hub")).where("n > 1")
    members = scratch.save(keys.join(sizes.select("key", "hub"), "key"))
    pairs = members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()

    involved = members.select("doc_id").distinct()
    involved = classes.select("doc_id", "first").join(involved, "doc_id").select(F.col("doc_id").alias("node"), "first.*")
    source = docs.select(row_id(id_column).alias("doc_id"), text_key(text_column).alias("text_key"), F.col(text_column).cast("string").alias("text"))
    texts = source.join(involved.hint("shuffle_hash"), ["doc_id", "text_key"]).select(F.col("node").alias("doc_id"), "text")
    texts = scratch.save(texts.dropDuplicates(["doc_id"]))

    links = verified(promising(pairs, classes, settings), texts, settings)
    labels = components(scratch, links)
    # Buckets that still hold more than one component.
    apart = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    apart = apart.select("key", "hub", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    open_keys = apart.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    apart = scratch.save(apart.join(open_keys.select("key"), "key").select("hub", "doc_id", "component").distinct(), few=True)
    if has_rows(apart):
        doubtful = scratch.save(still_promising(apart, classes, settings), few=True)
        labels = joined_labels(scratch, labels, links_of_the_rest(doubtful, texts, settings))
        scratch.drop(doubtful)
    scratch.drop(members, texts, apart)
    labels = labels.withColumnRenamed("node", "doc_id")
    classes = classes.select("digest", "doc_id", "first")
    # A component is known by its first document.
    tops = labels.join(classes, "doc_id").groupBy("component").agg(F.min("first").alias("top"))
    labels = labels.join(tops, "component").select("doc_id", "top")
    classes = classes.join(labels, "doc_id", "left").select("digest", F.coalesce("top", "first").alias("top"))
    out = rows.drop("registers").join(classes, "digest", "left")
    own = F.struct("doc_id", "text_key")
    out = out.withColumn("top", F.coalesce("top", own)).withColumn("kept", own == F.col("top"))
    out = out.withColumns({c: F.when(F.col(of) != LAST_ID, F.col(of)) for c, of in (("component_id", "top.doc_id"), ("doc_id", "doc_id"))})
    return out.select("doc_id", "n_shingles", "component_id", "kept", *(["text_key"] if keyed else []))


def joined_labels(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after new links between nodes."""
    left = labels.select(F.col("node").alias("a"), F.col("component").alias("a_to"))
    right = labels.select(F.col("node").alias("b"), F.col("component").alias("b_to"))
    between = links.join(left, "a", "left").join(right, "b", "left")
    between = between.select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
    new = components(scratch, between).select(F.col("node").alias("component"), F.col("component").alias("to"))
    kept = labels.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = new.select(F.col("component").alias("node"), F.col("to").alias("component"))
    return scratch.save(kept.union(fresh.join(kept.select("node"), "node", "left_anti")), few=True)


def in_blocks(apart: DataFrame, block: int) -> DataFrame:
    """(hub, x, y, is_rest, doc_id, component): every hub's documents outside its largest component, in blocks x, beside all of its
    documents, in blocks y. Nearly every hub has one block of each."""
    sizes = apart.groupBy("hub", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("hub").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("largest"))
    shares = sizes.select(
        "hub",
        F.col("largest.component").alias("largest"),
        F.ceil((F.col("all") - F.col("largest.n")) / block).cast("int").alias("rest_blocks"),
        F.ceil(F.col("all") / block).cast("int").alias("blocks"),
    )
    docs = apart.join(shares.where("rest_blocks > 0"), "hub")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rest = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("rest_blocks")).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = docs.where("component <> largest").select("hub", rest.alias("x"), every("blocks").alias("y"), F.lit(True).alias("is_rest"), "doc_id", "component")
    right = docs.select("hub", every("rest_blocks").alias("x"), own.alias("y"), F.lit(False).alias("is_rest"), "doc_id", "component")
    return left.union(right)


def still_promising(apart: DataFrame, classes: DataFrame, settings: NearDuplicates) -> DataFrame:
    """The rows (hub, doc_id, component) of apart that registers and sizes don't rule out to be linked to another component of the hub."""
    least = settings.percent / 100
    least -= 6 * np.sqrt(least * (1 - least) / settings.registers)
    rows = in_blocks(apart, settings.register_block).join(classes.select("doc_id", "n_shingles", "registers"), "doc_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        registers = np.frombuffer(b"".join(group["registers"]), np.uint16).reshape(len(group), -1)
        is_rest, component, n = group["is_rest"].to_numpy(bool), group["component"].to_numpy(), group["n_shingles"].to_numpy(np.float64)
        others = np.flatnonzero(~is_rest)
        found = np.zeros(len(group), bool)
        for x in np.flatnonzero(is_rest):
            fit = (component[others] != component[x]) & (np.minimum(n[x], n[others]) * 100 >= np.maximum(n[x], n[others]) * settings.percent)
            at = others[fit]
            # The estimate follows the share of equal registers closely; it is worked out where that share comes near.
            at = at[(registers[at] == registers[x]).mean(axis=1) >= least - 0.1]
            if len(at):
                a = np.broadcast_to(registers[x], (len(at), registers.shape[1]))
                at = at[estimate(a, registers[at], np.full(len(at), n[x]), n[at], settings.base) >= least]
                found[at] = True
                found[x] |= len(at) > 0
        return group.loc[found, ["hub", "doc_id", "component"]]

    return rows.groupBy("hub", "x", "y").applyInPandas(run, "hub long, doc_id long, component long").distinct()


def links_of_the_rest(doubtful: DataFrame, texts: DataFrame, settings: NearDuplicates) -> DataFrame:
    """Links between documents of different components that share a hub, by their whole sets."""
    rows = in_blocks(doubtful, settings.text_block).join(texts, "doc_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets([encoded(t) for t in group["text"]], settings.shingle)
        is_rest = group["is_rest"].to_numpy(bool)
        ids, component = group["doc_id"].to_numpy(), group["component"].to_numpy()
        others = np.flatnonzero(~is_rest)
        sizes = np.array([len(s) for s in sets])
        found = []
        if len(others):
            hashes = np.concatenate([sets[i] for i in others])
            owner = np.repeat(np.arange(len(others)), sizes[others])
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            for x in np.flatnonzero(is_rest):
                lo, hi = np.searchsorted(hashes, sets[x], "left"), np.searchsorted(hashes, sets[x], "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(others))
                alike = 100 * common >= settings.percent * (sizes[x] + sizes[others] - common)
                # One link joins two components, so one for each is enough.
                linked = np.flatnonzero(alike & (component[others] != component[x]))
                _, one = np.unique(component[others][linked], return_index=True)
                found += [(ids[x], ids[others[y]]) for y in linked[one]]
        return pd.DataFrame(found, columns=["a", "b"]).astype(np.int64)

    return rows.groupBy("hub", "x", "y").applyInPandas(run, "a long, b long")

"""What the corpus operators share: the shared scratch folder, connected components, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import shared_folder

#: The white space of the word rules: space and the control characters from tab to carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
#: Stands for a missing id where rows are put in order: it comes after every other.
LAST_ID = 2**63 - 1


class Scratch:
    """Tables written to the shared folder, so that later steps read them instead of doing their work again.

    A lost executor loses nothing of them. What the result still reads stays until the folder is cleared;
    `drop` removes what no later step needs.
    """

    def __init__(self, spark: SparkSession, name: str, corpus: DataFrame | None = None):
        self.spark = spark
        # Tables of ids and numbers take a small part of the corpus, so they get few files, as many more as it grows.
        self.few = max(8, (estimated_bytes(corpus) if corpus is not None else 0) >> 26)
        self.folder = f"{shared_folder(spark)}/tablewright-{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, few: bool = False, rows_per_file: int = 0) -> DataFrame:
        """The table, read from where it was written; `few`: it holds no texts."""
        self.count += 1
        df = df.coalesce(self.few) if few else df
        path = f"{self.folder}/{self.count:03d}"
        (df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """The size of what a frame reads, as far as the optimizer knows it; for files their size, for rows from the driver 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 2**60)


def shuffle_parts(df: DataFrame, each: int = 32 << 20) -> int:
    """Partitions for a shuffle that moves about as much as df holds."""
    return int(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(estimated_bytes(df) // each, 1_000_000)))


@contextmanager
def small_batches(spark: SparkSession, most: int = 1 << 20) -> Iterator[None]:
    """Jobs started inside hand Python tasks at most about `most` bytes at a time, or less where the session says so.

    A batch stands in an executor beside its heap two or three times, in buffers that grow by doubling. At Spark's 64 MB that is
    some hundred MB for each core. The session's setting is put back at the end.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= most:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Each round maps every node to its smallest neighbour and contracts the edges; the nodes that still have edges at least halve.
    Every step is a grouped minimum (combined before the shuffle) or an equi-join whose one side is unique, so no node's edges
    meet in one place.
    """
    edges = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), few=True)
    labels = None
    while has_rows(edges):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        step = scratch.save(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), few=True)
        if labels is None:
            new = step.select("node", F.col("to").alias("component"))
            labels = scratch.save(new, few=True)
        else:
            moved = step.select(F.col("node").alias("component"), "to")
            new = scratch.save(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), few=True)
            scratch.drop(labels)
            labels = new
        left = step.select(F.col("node").alias("a"), F.col("to").alias("a_to"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        nxt = edges.join(left, "a").join(right, "b").where("a_to <> b_to")
        nxt = scratch.save(nxt.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), few=True)
        scratch.drop(edges, step)
        edges = nxt
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def row_id(id_column: str) -> Column:
    """A row's id; a missing one comes after every other."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID))


def text_key(text_column: str) -> Column:
    """A hash of a row's text. It tells rows apart that share an id or have none; with `row_id` it is a row's key."""
    return F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))


def crc32_of_id(id_column: str) -> Column:
    """crc32 of an id's decimal text; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------------------------------------------------------------
# Hashing of words in whole batches of texts

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """step ** 0 .. step ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of the texts, letters A-Z lower-cased, and the number of words of each text."""
    buf = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", np.uint8)
    inside = ~_IS_SPACE[buf]
    edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    lengths = ends - starts
    at = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    offset = np.arange(len(at)) - np.repeat(first, lengths)
    sums = np.add.reduceat(_BYTE[buf[at]] * powers(int(lengths.max()))[offset], first)
    return mix(sums + lengths.astype(np.uint64)), counts


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words; of fewer words, of all as one run; else none."""
    words, counts = word_hashes(texts)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    runs = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for i in range(size):
        runs += words[i : i + len(runs)] * factors[i]
    runs = mix(runs)
    out, at = [], 0
    for n in counts:
        if n >= size:
            out.append(np.unique(runs[at : at + n - size + 1]))
        elif n:
            out.append(mix(np.array([(words[at : at + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)])))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def in_batches(texts: list[bytes], most: int = 1 << 18):
    """Slices of the list whose texts hold about `most` bytes together; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield slice(start, len(texts))


def text_column(schema: T.StructType, name: str = "text") -> Column:
    """The text column as string; of a table without it, empty."""
    return F.col(name).cast("string") if name in schema.fieldNames() else F.lit(None).cast("string")

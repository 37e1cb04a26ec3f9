"""Removal of repeated passages by a sparse suffix array.

A passage of `length` bytes that also starts earlier (in a document with a smaller id, or before in the same one) is removed;
overlapping passages count, and what is removed is judged on the input.

Sorting the suffixes at all bytes would move a hundred times the text. So suffixes start only at anchors: of the seeds
(runs of `seed` bytes) inside a passage the one with the smallest hash is its anchor, so equal passages have equal anchors at equal
places, and about one byte in 35 is an anchor. An anchor stands for the run of passages that choose it, together its context.

1. Anchors are dealt out by seed. Of anchors with equal contexts all but the first are settled: their whole context is repeated.
   Seeds that occur once are settled too. What is left are the first anchors of different contexts around one seed.
2. Their contexts are range-partitioned by the leading bytes of the anchor's suffix at sampled splitters, sorted in each bucket, and
   the passages inside the contexts are sorted byte by byte; all but the first of equal passages are repeats. Splitters
   never cut between suffixes with equal leading bytes, so no comparison has to cross a boundary.
3. The repeats of each document are merged and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import _BYTE, LAST_ID, Scratch, encoded, estimated_bytes, in_batches, mix, row_id, shuffle_parts, text_key

_BASE = 0x9E3779B97F4A7C15
_POSITION = np.uint64((1 << 24) - 1)
_SLICE = 4 << 20  # of longer texts; their passages are looked at slice by slice


@dataclass(frozen=True)
class Repeats:
    """Settings: bytes of a passage, and bytes of a seed (a power of two, at most half of the passage)."""

    length: int = 100
    seed: int = 32
    bucket_bytes: int = 2 << 20  # of stored text for each bucket of anchors


@dataclass
class Anchors:
    """Anchors of some texts: text number, first passage's start, further passages, anchor's distance from start, hashes."""

    text: np.ndarray
    start: np.ndarray
    more: np.ndarray
    ahead: np.ndarray
    seed: np.ndarray
    context: np.ndarray


def anchors(texts: list[bytes], settings: Repeats) -> Anchors:
    """The anchors of all passages of the texts; passages do not cross texts."""
    length, size = settings.length, settings.seed
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    if bounds[-1] < length:
        empty = np.empty(0, np.int64)
        return Anchors(empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    h = _BYTE[np.frombuffer(b"".join(texts), np.uint8)]
    n = 1
    while n < size:
        h = h[:-n] * np.uint64(pow(_BASE, n, 2**64)) + h[n:]
        n *= 2
    h = mix(h)
    least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    n, wide = 1, length - size + 1
    while n * 2 <= wide:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if wide > n:
        least = np.minimum(least[: len(least) - (wide - n)], least[wide - n :])
    long = sizes >= length
    change = np.zeros(bounds[-1] + 1, np.int32)
    np.add.at(change, bounds[:-1][long], 1)
    np.add.at(change, bounds[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(change[:-1]))
    if not len(start):
        return anchors([], settings)
    at = (least[start] & _POSITION).astype(np.int64)
    new = np.flatnonzero((at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = np.concatenate(([0], new)), np.concatenate((new - 1, [len(start) - 1]))
    lo, hi, at = start[first], start[last], at[first]
    context = mix(((hi - lo) * 257 + (at - lo)).astype(np.uint64))
    for i, offset in enumerate([*range(0, length - size, size), length - size]):
        for side in (lo, hi):
            context = context * np.uint64(_BASE) + h[side + offset] * np.uint64(2 * i + 1)
    text = np.searchsorted(bounds, lo, "right") - 1
    return Anchors(text, lo - bounds[text], hi - lo, at - lo, h[at], mix(context))


def sliced_anchors(texts: list[bytes], settings: Repeats) -> Iterator[Anchors]:
    """Anchors of texts of any length, a bounded part at a time."""
    for part in in_batches(texts):
        if part.stop - part.start > 1 or len(texts[part.start]) <= _SLICE:
            found = anchors(texts[part], settings)
            found.text = found.text + part.start
            yield found
            continue
        for at in range(0, len(texts[part.start]), _SLICE):
            found = anchors([texts[part.start][at : at + _SLICE + settings.length - 1]], settings)
            found.text, found.start = found.text + part.start, found.start + at
            yield found


_PACKED = T.StructType(
    [T.StructField("bucket", T.LongType())]
    + [T.StructField(c, T.BinaryType()) for c in ("doc", "twin", "start", "more", "ahead", "seed", "context")]
)
_KINDS = {"doc": np.int64, "twin": np.int64, "start": np.uint32, "more": np.uint8, "ahead": np.uint8, "seed": np.uint32, "context": np.uint64}


def _same_place(a: dict[str, np.ndarray]) -> np.ndarray:
    """Which anchors lie at the place of the one before, in an equal row."""
    return np.concatenate(([False], np.logical_and.reduce([a[c][1:] == a[c][:-1] for c in ("doc", "twin", "start")])))[: len(a["doc"])]


def packed_anchors(source: DataFrame, settings: Repeats, buckets: int) -> DataFrame:
    """Anchors of rows (doc_id, twin, text), packed by bucket of their seeds; anchors that repeat a context of their own batch have no seed and lie in any bucket."""

    def pack(bucket: int, columns: dict[str, np.ndarray], chosen: np.ndarray) -> dict:
        out = {c: columns[c][chosen] for c in columns}
        for c in ("doc", "twin"):
            out[c] = np.diff(out[c], prepend=0)  # small steps compress well
        return {"bucket": bucket} | {c: v.astype(_KINDS[c]).tobytes() for c, v in out.items()}

    def rows_of(ids: np.ndarray, twins: np.ndarray, texts: list[bytes]) -> list[dict]:
        found = list(sliced_anchors(texts, settings))
        a = {c: np.concatenate([getattr(x, c) for x in found]) for c in ("text", "start", "more", "ahead", "seed", "context")}
        if not len(a["text"]):
            return []
        text = a.pop("text")
        a["doc"], a["twin"] = ids[text], twins[text]
        order = np.lexsort((a["start"], a["twin"], a["doc"], a["context"]))
        a = {c: v[order] for c, v in a.items()}
        again = np.concatenate(([False], a["context"][1:] == a["context"][:-1]))
        same = _same_place(a) & again
        rows = []
        settled = np.flatnonzero(again & ~same)
        settled = settled[np.lexsort((a["twin"][settled], a["doc"][settled]))]
        for chosen in np.array_split(settled, max(1, len(settled) // 20_000)):
            if len(chosen):
                rows.append(pack(int(a["seed"][chosen[0]] % buckets), {c: a[c] for c in ("doc", "twin", "start", "more")}, chosen) | {"ahead": b"", "seed": b"", "context": b""})
        left = np.flatnonzero(~again)
        bucket = (a["seed"] % np.uint64(buckets)).astype(np.int64)
        left = left[np.lexsort((a["start"][left], a["twin"][left], a["doc"][left], bucket[left]))]
        a["seed"] = a["seed"] >> np.uint64(32)
        return rows + [pack(int(bucket[chosen[0]]), a, chosen) for chosen in np.split(left, np.flatnonzero(np.diff(bucket[left])) + 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, twins, texts = batch["doc_id"].to_numpy(), batch["twin"].to_numpy(), [encoded(t) for t in batch["text"]]
            for part in in_batches(texts, 8 << 20):  # contexts that repeat within so much text are settled before the shuffle
                rows = rows_of(ids[part], twins[part], texts[part])
                if rows:
                    yield pd.DataFrame(rows)

    return source.mapInPandas(run, _PACKED)


def settle(packed: DataFrame) -> DataFrame:
    """(doc_id, twin, start, more, ahead): settled repeats (ahead is NULL) and anchors whose passages must be compared."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        loose = group["seed"].str.len() == 0

        def column(rows: pd.DataFrame, c: str) -> np.ndarray:
            parts = [np.frombuffer(v, _KINDS[c]) for v in rows[c]]
            parts = [np.cumsum(p) for p in parts] if c in ("doc", "twin") else parts
            return np.concatenate(parts) if parts else np.empty(0, _KINDS[c])

        done = {c: column(group[loose], c) for c in ("doc", "twin", "start", "more")}
        a = {c: column(group[~loose], c) for c in _KINDS}
        order = np.lexsort((a["start"], a["twin"], a["doc"], a["context"], a["seed"]))
        a = {c: v[order] for c, v in a.items()}
        n = len(order)
        seed_starts = np.concatenate(([True], a["seed"][1:] != a["seed"][:-1]))[:n]
        class_starts = seed_starts | np.concatenate(([True], a["context"][1:] != a["context"][:-1]))[:n]
        again = ~class_starts
        same = again & _same_place(a)
        groups = np.cumsum(seed_starts) - 1
        several = np.bincount(groups, class_starts)[groups] > 1 if n else np.empty(0, bool)
        settled, compare = again & ~same, class_starts & several
        return pd.DataFrame(
            {
                "doc_id": np.concatenate((done["doc"], a["doc"][settled], a["doc"][compare])),
                "twin": np.concatenate((done["twin"], a["twin"][settled], a["twin"][compare])),
                "start": np.concatenate((done["start"], a["start"][settled], a["start"][compare])).astype(np.int64),
                "more": np.concatenate((done["more"], a["more"][settled], a["more"][compare])).astype(np.int32),
                "ahead": pd.array([None] * (len(done["doc"]) + int(settled.sum())) + a["ahead"][compare].tolist(), "Int32"),
            }
        )

    return packed.groupBy("bucket").applyInPandas(run, "doc_id long, twin long, start long, more int, ahead int")


def contexts(source: DataFrame, compare: DataFrame, settings: Repeats, parts: int) -> DataFrame:
    """(lead, doc_id, twin, start, context) of the anchors that must be compared; lead: the first bytes of the anchor's suffix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, twin, text, found in zip(batch["doc_id"], batch["twin"], batch["text"], batch["found"], strict=True):
                data = encoded(text)
                for x in found:
                    lo, at = x["start"], x["start"] + x["ahead"]
                    rows.append((data[at : at + settings.seed], doc, twin, lo, data[lo : lo + x["more"] + settings.length]))
            for at in range(0, len(rows), 20_000):
                yield pd.DataFrame(rows[at : at + 20_000], columns=["lead", "doc_id", "twin", "start", "context"])

    found = compare.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "more", "ahead")).alias("found"))
    joined = source.repartition(parts, "doc_id", "twin").join(found.repartition(parts, "doc_id", "twin").hint("shuffle_hash"), ["doc_id", "twin"])
    return joined.mapInPandas(run, "lead binary, doc_id long, twin long, start long, context binary")


def compared(found: DataFrame, settings: Repeats, parts: int) -> DataFrame:
    """(doc_id, twin, start, stop): bytes of passages that also occur in an earlier context, with any equal leading bytes."""

    def repeats(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["doc_id", "twin", "start"]).sort_values(["doc_id", "twin", "start"])
        data = list(rows["context"])
        sizes = np.array([len(d) for d in data])
        ends = np.cumsum(sizes)
        more = sizes - settings.length + 1
        row = np.repeat(np.arange(len(data)), more)
        within = np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more)
        begins = (ends - sizes)[row] + within
        window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(data), np.uint8), settings.length)[begins]
        window = np.ascontiguousarray(window).view(f"S{settings.length}")[:, 0]
        order = np.argsort(window, kind="stable")  # equal passages stay in the order of documents and places
        again = np.zeros(len(row), bool)
        again[order[1:]] = window[order[1:]] == window[order[:-1]]
        hit = np.flatnonzero(again)
        cuts = np.flatnonzero((np.diff(hit) != 1) | (np.diff(row[hit]) != 0)) + 1
        if not len(hit):
            return pd.DataFrame({"doc_id": [], "twin": [], "start": [], "stop": []}).astype(np.int64)
        first, last = hit[np.concatenate(([0], cuts))], hit[np.concatenate((cuts - 1, [len(hit) - 1]))]
        ids, twins, starts = rows["doc_id"].to_numpy(), rows["twin"].to_numpy(), rows["start"].to_numpy()
        return pd.DataFrame(
            {"doc_id": ids[row[first]], "twin": twins[row[first]], "start": starts[row[first]] + within[first], "stop": starts[row[last]] + within[last] + settings.length}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch["lead"].iloc[-1]
            open_rows = batch["lead"] == last
            if held and held[-1]["lead"].iloc[-1] == last and open_rows.all():
                held.append(batch)
                continue
            if held or not open_rows.all():
                yield repeats(pd.concat([*held, batch[~open_rows]]))
            held = [batch[open_rows]]
        if held:
            yield repeats(pd.concat(held))

    ordered = found.repartitionByRange(parts, "lead").sortWithinPartitions("lead", "doc_id", "twin", "start")
    return ordered.mapInPandas(run, "doc_id long, twin long, start long, stop long")


def without_repeats(
    docs: DataFrame, settings: Repeats = Repeats(), id_column: str = "doc_id", text_column: str = "text", digest: bool = False
) -> DataFrame:
    """All rows and columns of docs, with the bytes of repeated passages cut out of the text (bytes that are then no whole
    character go too), and the columns n_bytes, n_removed and n_spans added, which take the place of columns of that name.

    With digest=True only doc_id, the three counts and kept_sha256, the digest of the remaining bytes.
    A NULL text stays NULL and counts as empty. A missing id counts as the largest. Equal rows (id and text) count as one document: they
    don't repeat each other and get equal results. Different texts under one id, or without any, are documents of their own, in the
    order of a hash of their texts.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    key = [row_id(id_column).alias("doc_id"), text_key(text_column).alias("twin"), F.col(text_column).cast("string").alias("text")]
    source = docs.select(*key)
    parts = shuffle_parts(docs, 8 << 20)
    buckets = int(min(max(64, estimated_bytes(docs) // settings.bucket_bytes), 100_000_000))
    flags = scratch.save(settle(packed_anchors(source, settings, buckets)))
    open_flags = flags.where("ahead is not null")
    found = scratch.save(contexts(source, open_flags, settings, parts))
    more = compared(found, settings, shuffle_parts(found, 4 << 20))
    cut = flags.where("ahead is null").select("doc_id", "twin", "start", (F.col("start") + F.col("more") + settings.length).alias("stop")).union(more)
    cut = cut.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "stop")).alias("cut"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["cut"], strict=True):
                data = encoded(text)
                kept, at, removed, count = [], 0, 0, 0
                for lo, hi in merged([] if spans is None else spans):
                    kept.append(data[at:lo])
                    at, removed, count = hi, removed + hi - lo, count + 1
                rest = b"".join([*kept, data[at:]])
                out.append((len(data), removed, count, hashlib.sha256(rest).hexdigest() if digest else None if text is None else rest.decode("utf-8", "ignore")))
            new = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "result"], index=batch.index)
            yield pd.concat([batch.drop(columns=["text", "cut"]), new], axis=1)

    added = ["n_bytes", "n_removed", "n_spans"]
    carried = [] if digest else [c for c in docs.columns if c not in (text_column, *added)]
    row = F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row") if carried else F.lit(None).cast("int").alias("row")
    wide = docs.select(*key, row)
    wide = wide.repartition(parts, "doc_id", "twin").join(cut.repartition(parts, "doc_id", "twin").hint("shuffle_hash"), ["doc_id", "twin"], "left")
    kinds = T.StructType([wide.schema["doc_id"], wide.schema["row"], *[T.StructField(c, T.LongType()) for c in added], T.StructField("result", T.StringType())])
    done = wide.select("doc_id", "row", "text", "cut").mapInPandas(run, kinds)
    if digest:
        return done.select(F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")).alias("doc_id"), *added, F.col("result").alias("kept_sha256"))
    columns = [F.col("result").alias(c) if c == text_column else F.col(f"row.`{c}`") for c in docs.columns if c not in added]
    return done.select(*columns, *added)


def merged(spans: list) -> list[tuple[int, int]]:
    """Spans (start, stop) in order, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["start"], s["stop"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]

"""Phrases whose words stand together more often than their parts would by chance.

SON partitioning: the corpus is mined shard by shard (a shard is what a task holds at a time, stored as numbers of its words). A
phrase that reaches the support in
the whole corpus reaches, in at least one shard, the support lowered to that shard's share of all words, so the union of what is
locally frequent misses nothing. A shard also tells how often a phrase stands there; where it is silent the phrase stayed below its
support, so the union is thinned to what can still reach the support. Then the candidates are counted exactly everywhere. This runs three times: for words, for pairs of
frequent words, and for longer phrases all of whose pairs are frequent. So where shards are so many that the lowered support
comes down to 1, a shard still proposes pairs of frequent words and runs of frequent pairs only, not everything it holds.

Candidates reach the tasks as a bitmap of fixed size. A phrase that shares its bit with a candidate is counted too, everywhere and
so exactly, and falls below the support by its own count; however full the bitmap is, the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch, estimated_bytes, mix, shuffle_parts, small_batches

#: All that separates pieces becomes a full stop, which so is never part of a word; what separates words becomes a space.
_FOLD = bytearray(range(256))
for _upper in range(65, 91):
    _FOLD[_upper] = _upper + 32
for _mark in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_mark] = ord(".")
_FOLD[9] = 32
_FOLD = bytes(_FOLD)
_SLICE = 1 << 20


@dataclass(frozen=True)
class Collocations:
    """support: least count; longest: words of a phrase; absorbed: a longer candidate with this share (hundredths) of a phrase's
    count takes its place; top: rows of a language; shard_words: words that a task mines at a time; count_words: that it counts at a
    time, with their spelling; held: phrases whose counts a task holds before it sends them; part_words: words of a stored row; bits: the bitmap has 2 ** bits."""

    support: int = 100
    longest: int = 5
    absorbed: int = 100
    top: int = 2000
    shard_words: int = 1 << 21
    count_words: int = 1 << 19
    held: int = 1 << 19
    part_words: int = 1 << 18
    bits: int = 25


class _Codes(dict):
    """Numbers of one language's words; 0 is the end of a piece."""

    def __init__(self, lang: str, book: list[tuple[str, bytes]]):
        super().__init__({b".": 0})
        self.lang, self.book = lang, book

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.book)
        self.book.append((self.lang, word))
        return code


def _slices(data: bytes) -> Iterator[bytes]:
    """A folded text in parts of about a megabyte, cut at spaces."""
    at = 0
    while len(data) - at > _SLICE:
        end = data.find(b" ", at + _SLICE)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def parts_of(rows: Iterator[tuple[str, bytes | None]], part_words: int) -> Iterator[tuple[list[tuple[str, bytes]], np.ndarray]]:
    """(book, codes): the words of a part in order, as numbers of entries (lang, word) of its book; 0 ends a piece.

    A part ends at the end of a piece, so that no phrase is cut; a long text makes several parts.
    """

    def fresh():
        return [("", b".")], {}, [], 0

    book, langs, parts, n = fresh()
    for lang, text in rows:
        codes = langs.get(lang)
        for part in _slices((text or b"").translate(_FOLD).replace(b".", b" . ") + b" ."):
            if codes is None:
                codes = langs[lang] = _Codes(lang, book)
            words = part.split()
            parts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
            n += len(words)
            if n >= part_words:
                whole = np.concatenate(parts)
                ends = np.flatnonzero(whole == 0)
                if not len(ends):
                    parts = [whole]
                    continue
                last, old = ends[-1] + 1, book
                rest = whole[last:]
                yield old, whole[:last]
                book, langs, parts, n = fresh()
                codes = langs[lang] = _Codes(lang, book)
                parts.append(np.fromiter((codes[old[c][1]] for c in rest), np.int32, len(rest)))
                n = len(rest)
    if n:
        yield book, np.concatenate(parts)


def _word_keys(book: list[tuple[str, bytes]]) -> np.ndarray:
    seeds = {}
    for lang, _ in book:
        if lang not in seeds:
            seeds[lang] = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh3_64_intdigest(word, seeds[lang]) for lang, word in book), np.uint64, len(book))


CODED = "langs array<string>, lang_of binary, words binary, keys binary, codes binary"


def coded(source: DataFrame, part_words: int) -> DataFrame:
    """A row for each part: its words once, each with its language and a 64-bit key, and the corpus as their numbers (0 ends a piece)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # so that few texts stand beside the batch
                part = batch.slice(at, 256)
                yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book, codes in parts_of(rows(batches), part_words):
            langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in book[1:]))}
            lang_of = np.fromiter((langs[lang] for lang, _ in book[1:]), np.int32, len(book) - 1)
            words = b" ".join([word for _, word in book[1:]])
            row = [list(langs), lang_of.tobytes(), words, _word_keys(book).tobytes(), codes.astype(np.int32).tobytes()]
            kinds = [pa.list_(pa.string()), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["langs", "lang_of", "words", "keys", "codes"])

    return source.select("lang", F.col("text").cast("binary")).mapInArrow(run, CODED)


@dataclass
class _Shard:
    """Parts that a task holds together. Without words, codes tell no words apart but those of pieces' ends."""

    codes: np.ndarray  # at each place the number of its word; 0 ends a piece
    keys: np.ndarray  # at each place its word's key
    langs: list[str] | None  # of each number
    words: list[bytes] | None


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[_Shard]:
    """Shards put together from the rows of `coded`; their words get numbers of their own where the rows have words."""
    codes, keys, numbers, langs, words, n = [], [], {}, [""], [b"."], 0
    for batch in batches:
        named = "words" in batch.schema.names
        for at in range(batch.num_rows):

            def numbers_in(column: str, kind: type, batch=batch, at=at) -> np.ndarray:
                return np.frombuffer(batch.column(column)[at].as_buffer(), kind)

            own = numbers_in("codes", np.int32)
            keys.append(numbers_in("keys", np.uint64)[own])
            if named:
                known = batch.column("langs")[at].as_py()
                mine = batch.column("words")[at].as_py().split(b" ")
                to = np.zeros(len(mine) + 1, np.int32)
                for i, (lang, word) in enumerate(zip(numbers_in("lang_of", np.int32).tolist(), mine, strict=False), 1):
                    of_lang = numbers.setdefault(known[lang], {})
                    if word not in of_lang:
                        of_lang[word] = len(words)
                        langs.append(known[lang])
                        words.append(word)
                    to[i] = of_lang[word]
                own = to[own]
            codes.append(own)
            n += len(own)
            if n >= shard_words:
                shard = _Shard(np.concatenate(codes), np.concatenate(keys), langs, words)
                codes, keys, numbers, langs, words, n = [], [], {}, [""], [b"."], 0
                yield shard
                del shard
                pa.default_memory_pool().release_unused()
    if n:
        shard = _Shard(np.concatenate(codes), np.concatenate(keys), langs, words)
        del codes, keys, numbers
        yield shard


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _phrase_keys(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit keys of the phrases of `size` words at the places `at`; keys: those of the words at all places."""
    out = np.full(len(at), size, np.uint64)
    for start in range(0, len(at), 1 << 16):  # so that what is computed on the way stays small
        own, places = out[start : start + (1 << 16)], at[start : start + (1 << 16)]
        for i in range(size):
            own += keys[places + i] * _FACTORS[i]
        own[:] = mix(own)
    return out


def _known(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether each key's bit is set."""
    at = (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _runs(joined: np.ndarray, size: int) -> np.ndarray:
    """Where `size` - 1 places in a row are joined to their next."""
    n = len(joined) - size + 2
    ok = np.ones(max(n, 0), bool)
    for i in range(size - 1):
        ok &= joined[i : i + len(ok)]
    return np.flatnonzero(ok)


def _joined(shard: _Shard, words: np.ndarray, pairs: np.ndarray | None, bits: int) -> np.ndarray:
    """For each place but the last, whether it and the next are frequent words of one piece and, if pairs are known, a frequent pair."""
    ok = (shard.codes > 0) & _known(words, mix(shard.keys * _FACTORS[0] + np.uint64(1)), bits)
    ok = ok[:-1] & ok[1:]
    if pairs is not None:
        at = np.flatnonzero(ok)
        ok[at] = _known(pairs, _phrase_keys(shard.keys, at, 2), bits)
    return ok


BLOCK = 15  # a block of the bitmap has 2 ** 15 bits


def _blocks(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """(block, bits): the blocks of a bitmap in which the keys' bits are set."""
    at = np.unique(keys & np.uint64((1 << bits) - 1)).astype(np.int64)
    block, start = np.unique(at >> BLOCK, return_index=True)
    whole = np.zeros((len(block), 1 << BLOCK), bool)
    whole[np.repeat(np.arange(len(block)), np.diff([*start, len(at)])), at & ((1 << BLOCK) - 1)] = True
    packed = [b.tobytes() for b in np.packbits(whole, axis=1, bitorder="little")]
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(packed, pa.binary())], ["block", "bits"])


def _sent(blocks: DataFrame, bits: int):
    """The bitmap of the blocks that tasks made, sent to every task: 2 ** bits bits, however many candidates there are."""
    whole = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (BLOCK - 3)
    for row in blocks.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits")).collect():
        whole[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(bytes(row["bits"]), np.uint8)[:size]
    return blocks.sparkSession.sparkContext.broadcast(whole)


PHRASES = "lang string, phrase string, f long"
_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _told(counts: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of the counts of each language, which are emptied."""
    while counts:
        lang, own = counts.popitem()
        found = iter(own.items())
        while part := list(islice(found, 20_000)):
            columns = [[lang] * len(part), [phrase.decode("utf-8", "replace") for phrase, _ in part], [f for _, f in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, _PHRASES, strict=True)], schema=_PHRASES)


def _count_words(corpus: DataFrame, settings: Collocations) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[bytes, int]] = {}
        n = 0

        def told() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                words, numbers = list(own), list(own.values())
                for at in range(0, len(words), 20_000):
                    phrases = [w.decode("utf-8", "replace") for w in words[at : at + 20_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(numbers[at : at + 20_000], pa.int64())], schema=_PHRASES)
            counts.clear()

        for batch in batches:
            for at in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[at].as_buffer(), np.int32)
                lang_of = np.frombuffer(batch.column("lang_of")[at].as_buffer(), np.int32)
                langs = [counts.setdefault(lang, {}) for lang in batch.column("langs")[at].as_py()]
                words = batch.column("words")[at].as_py().split(b" ")
                for lang, word, times in zip(lang_of.tolist(), words, np.bincount(codes, minlength=len(lang_of) + 1)[1:].tolist(), strict=False):
                    langs[lang][word] = langs[lang].get(word, 0) + times
                n += len(codes)
                if n >= settings.shard_words:
                    yield from told()
                    n = 0
        yield from told()

    counted = corpus.select("langs", "lang_of", "words", "codes").mapInArrow(run, PHRASES)
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _evidence(keys: np.ndarray, counts: np.ndarray, least: int, bits: int) -> pa.RecordBatch:
    """(block, places, beyond, below): by block of the bitmap, the places of locally frequent phrases and by how much each exceeds what a
    shard may keep silent about; that much, `below`, stands in a row of its own."""
    at, owner = np.unique((keys & np.uint64((1 << bits) - 1)).astype(np.int64), return_inverse=True)
    beyond = np.bincount(owner, counts - (least - 1), len(at)).astype(np.uint32)
    block, start = np.unique(at >> BLOCK, return_index=True)
    places = np.split((at & ((1 << BLOCK) - 1)).astype(np.uint16), start[1:]) if len(at) else []
    parts = np.split(beyond, start[1:]) if len(at) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array([-1, *block.tolist()], pa.int64()),
            pa.array([b"", *[x.tobytes() for x in places]], pa.binary()),
            pa.array([b"", *[x.tobytes() for x in parts]], pa.binary()),
            pa.array([least - 1, *[0] * len(block)], pa.int64()),
        ],
        ["block", "places", "beyond", "below"],
    )


def _mine(corpus: DataFrame, settings: Collocations, sizes: range, total: int, words, pairs) -> DataFrame:
    """What every shard tells of its locally frequent phrases, as `_evidence`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, settings.shard_words):
            least = max(1, -(-settings.support * int((shard.codes > 0).sum()) // total))
            frequent, times = [], []
            at = _runs(_joined(shard, words.value, pairs.value if pairs else None, settings.bits), sizes[0])
            for size in sizes:
                keys = _phrase_keys(shard.keys, at, size)
                found, counts = np.unique(keys, return_counts=True)
                frequent.append(found[counts >= least])
                times.append(counts[counts >= least])
                # Both parts of a longer phrase that lack one of its words are locally frequent as well.
                live = np.zeros(len(shard.codes) + 1, bool)
                live[at] = np.isin(keys, frequent[-1], kind="sort") if size < sizes[-1] else False
                at = np.flatnonzero(live[:-1] & live[1:])
            yield _evidence(np.concatenate(frequent), np.concatenate(times), least, settings.bits)

    return corpus.select("keys", "codes").mapInArrow(run, "block long, places binary, beyond binary, below long")


def _candidates(scratch: Scratch, mined: DataFrame, settings: Collocations):
    """The bitmap of the phrases that may reach the support, given what all shards tell."""
    mined = scratch.save(mined)
    silent = mined.agg(F.sum("below")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, np.zeros(1 << BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            bits = np.packbits((sums > 0) & (sums + silent >= settings.support), bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bits], pa.binary())], ["block", "bits"])

        # A block's rows come one after the other, however many shards there are.
        for batch in batches:
            for i, at in enumerate(batch.column(0).to_pylist()):
                if at != block:
                    if block is not None:
                        yield done()
                    block = at
                    sums[:] = 0
                sums[np.frombuffer(batch.column(1)[i].as_buffer(), np.uint16)] += np.frombuffer(batch.column(2)[i].as_buffer(), np.uint32)
        if block is not None:
            yield done()

    told = mined.where("block >= 0").select("block", "places", "beyond")
    parts = min(shuffle_parts(mined), 1 << (settings.bits - BLOCK))
    blocks = told.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, "block long, bits binary")
    return _sent(blocks, settings.bits)


def _told_counts(corpus: DataFrame, settings: Collocations, sizes: range, words, pairs, candidates) -> DataFrame:
    """(lang, phrase, f): what tasks tell of every phrase whose bit is set in the candidates.

    A phrase is told once by each task, as long as its counts fit; so there are about as many tasks as cores, and more only where each
    would read more than a gigabyte.
    """
    bits = settings.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, dict[bytes, int]] = {}
        for shard in _shards(batches, settings.count_words):
            ok = _joined(shard, words.value, pairs.value if pairs else None, bits)
            for size in sizes:
                at = _runs(ok, size)
                at = at[_known(candidates.value, _phrase_keys(shard.keys, at, size), bits)]
                # Phrases are told apart by the numbers of their words, not by keys.
                own = shard.codes[at].astype(np.int64)
                for i in range(1, size):
                    own = np.unique(own, return_inverse=True)[1] if i > 1 else own
                    own = own * len(shard.words) + shard.codes[at + i]
                _, first, counts = np.unique(own, return_index=True, return_counts=True)
                for start in range(0, len(first), 10_000):
                    places, every = at[first[start : start + 10_000]], counts[start : start + 10_000]
                    for row, times in zip(shard.codes[places[:, None] + np.arange(size)].tolist(), every.tolist(), strict=True):
                        of_lang = totals.setdefault(shard.langs[row[0]], {})
                        phrase = b" ".join([shard.words[c] for c in row])
                        of_lang[phrase] = of_lang.get(phrase, 0) + times
            # Counts of several shards are told together.
            if sum(map(len, totals.values())) >= settings.held:
                yield from _told(totals)
        yield from _told(totals)

    tasks = max(corpus.sparkSession.sparkContext.defaultParallelism, estimated_bytes(corpus) >> 30)
    return corpus.coalesce(tasks).mapInArrow(run, PHRASES)


def _count(corpus: DataFrame, settings: Collocations, sizes: range, words, pairs, candidates) -> DataFrame:
    """(lang, phrase, f) of every phrase of the least support whose bit is set in the candidates; counts are exact."""
    counted = _told_counts(corpus, settings, sizes, words, pairs, candidates).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counted.where(F.col("f") >= settings.support)


def _frequent(scratch: Scratch, source: DataFrame, settings: Collocations) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of every phrase of the least support, words included, and (lang, n)."""
    # Parts are long rows, so a file gets few of them.
    corpus = scratch.save(coded(source, settings.part_words), rows_per_file=16)
    everything = scratch.save(_count_words(corpus, settings))
    totals = scratch.save(everything.groupBy("lang").agg(F.sum("f").alias("n")), few=True)
    words = everything.where(F.col("f") >= settings.support)
    total = totals.agg(F.sum("n")).first()[0]
    tables = [words.select("lang", "phrase", F.lit(1).alias("size"), "f")]
    bits = settings.bits

    def known(table: DataFrame, size: int):
        """The bitmap of the table's phrases."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    book = [(lang, word) for lang, phrase in rows for word in phrase.encode().split(b" ")]
                    yield _blocks(_phrase_keys(_word_keys(book), np.arange(0, len(book), size), size), bits)

        return _sent(table.select("lang", "phrase").mapInArrow(run, "block long, bits binary"), bits)

    if total and settings.longest > 1:
        word_bits = known(words, 1)
        candidates = _candidates(scratch, _mine(corpus, settings, range(2, 3), total, word_bits, None), settings)
        pairs = scratch.save(_count(corpus, settings, range(2, 3), word_bits, None, candidates))
        tables.append(pairs.select("lang", "phrase", F.lit(2).alias("size"), "f"))
        if settings.longest > 2:
            pair_bits = known(pairs, 2)
            sizes = range(3, settings.longest + 1)
            candidates = _candidates(scratch, _mine(corpus, settings, sizes, total, word_bits, pair_bits), settings)
            longer = scratch.save(_count(corpus, settings, sizes, word_bits, pair_bits, candidates))
            tables.append(longer.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"))
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out, totals


def score() -> Column:
    """floor(1000 a n / (l r)) of whole numbers; decimals hold both products, and what is left over decides nothing."""
    a, n, left, right = (F.col(c).cast("decimal(19,0)") for c in "anlr")
    above = ((a * n).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")
    below = (left * right).cast("decimal(38,0)")
    return ((above - F.pmod(above, below)) / below).cast("decimal(38,0)").cast("long")


def collocations(docs: DataFrame, settings: Collocations = Collocations(), text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    a: the phrase's count, n: all words of the language; of its cuts the one with the lowest score floor(1000 a n / (l r)) counts, at
    equal scores the earliest. A phrase inside a longer candidate of (nearly) the same count is left out. Sorted by score and a, both
    descending, then by the phrase's bytes. A NULL language is `und`; NULL and empty texts and texts of separators only have no
    words; repeated rows count as often as they stand there; a long text is mined in several shards. A table without a phrase
    of the least support gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "collocations", docs)
    lang = F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit("und"))
    source = docs.select(lang.alias("lang"), F.col(f"`{text_column}`").cast("string").alias("text"))
    # All its tables are written inside; rows of the corpus take some MB each.
    with small_batches(docs.sparkSession):
        found, totals = _frequent(scratch, source, settings)
    frequent = scratch.save(found.select("lang", "phrase", F.col("size").cast("int").alias("size"), "f"))
    candidates = frequent.where("size > 1")
    # A count never grows with the phrase, so a longer candidate that takes a phrase's place has one of a single word more inside.
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "))
    above = candidates.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("longer"))
    above = above.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(above, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {settings.absorbed} * f")
    cuts = kept.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "tail": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    parts = frequent.select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(totals, "lang")
    cuts = cuts.withColumn("score", score())
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= settings.top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

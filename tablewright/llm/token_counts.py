"""Token counts with a digest cache.

A text's digest and the tokenizer's digest are looked up in a stored table of counts. Only distinct texts that are not there are
encoded; their counts are appended to the table, and the result is joined from it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import LAST_ID, shuffle_parts
from tablewright.llm.native import text_of

CACHE = "tokenizer string, digest binary, n_tokens long"


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer as the bytes of its file, which are sent to the tasks; kind: json, model or tiktoken."""

    kind: str
    data: bytes
    pattern: str | None = None  # how tiktoken splits a text into words

    @classmethod
    def read(cls, path: str, pattern: str | None = None) -> TokenizerFile:
        with open(path, "rb") as f:
            return cls(path.rsplit(".", 1)[-1], f.read(), pattern)

    @property
    def version(self) -> str:
        return hashlib.sha256(self.kind.encode() + b"\0" + (self.pattern or "").encode() + b"\0" + self.data).hexdigest()

    def counter(self) -> Callable[[list[str]], list[int]]:
        """Numbers of tokens of texts as the tokenizer's library gives them, without special tokens added."""
        if self.kind == "json":
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(self.data.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        if self.kind == "model":
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.data.splitlines() if line)}
        encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]


def stored_counts(docs: DataFrame, cache: str) -> DataFrame:
    """The cache at that path; without one yet, an empty table."""
    spark = docs.sparkSession
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(
    docs: DataFrame, tokenizer: TokenizerFile, cache: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit. The cache at the path `cache` gets the new counts.

    A NULL text is empty. Equal texts are encoded once, whatever their ids; a missing id stays NULL. A table without rows adds nothing.
    """
    version = tokenizer.version
    text = text_of(f"`{text_column}`")
    source = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("doc_id"), text.alias("text"))
    source = source.withColumn("digest", F.unhex(F.sha2("text", 256)))
    wanted = source.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    known = stored_counts(docs, cache).where(F.col("tokenizer") == version)
    misses = wanted.join(known, "digest", "left_anti")
    parts = shuffle_parts(docs, 4 << 20)
    # The copy with the smallest id of each missing text is encoded; the small side is the one that is built into a table.
    texts = source.repartition(parts, "doc_id", "digest").join(misses.repartition(parts, "doc_id", "digest").hint("shuffle_hash"), ["doc_id", "digest"], "left_semi")
    texts = texts.dropDuplicates(["doc_id", "digest"])  # repeated rows; they lie in one partition already

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = tokenizer.counter()
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                yield pd.DataFrame({"tokenizer": version, "digest": part["digest"], "n_tokens": count(part["text"].tolist())})

    texts.select("digest", "text").mapInPandas(run, CACHE).write.mode("append").parquet(cache)
    # Two jobs may have encoded the same text at the same time.
    counts = stored_counts(docs, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = source.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(counts, "digest").select(
        F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

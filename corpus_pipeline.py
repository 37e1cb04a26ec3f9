"""The corpus pipeline: from documents to the mixture that is trained on, in stages over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch, row_id, table, text_key
from tablewright.llm.decontamination import leaks
from tablewright.llm.minhash import near_duplicates
from tablewright.llm.mixing import mix_sources
from tablewright.llm.quality import fit_quality, score_quality
from tablewright.llm.suffix_dedup import without_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of each row: ids may be missing or repeated, so id and text tell rows apart."""
    return docs.withColumns({"__id": row_id("doc_id"), "__text": text_key("text")})


def _keys(found: DataFrame) -> DataFrame:
    """The keys of an operator's rows."""
    return found.select(row_id("doc_id").alias("__id"), F.col("text_key").alias("__text")).distinct()


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of the documents at hand, does not reject."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return score_quality(docs, model, name="__score").where("__score >= 0.5").select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, by id and for one id by a hash of the text; of rows that repeat id and text, one."""
    kept = _keys(near_duplicates(docs, keyed=True).where("kept"))
    rows = _keyed(docs).join(kept.hint("shuffle_hash"), ["__id", "__text"], "left_semi")
    return rows.dropDuplicates(["__id", "__text"]).select(docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; those of which nothing is left go."""
    out = without_repeats(docs).where("n_removed = 0 or n_removed < n_bytes")
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = _keys(leaks(docs, table(spark, sf_dir, "benchmark"), keyed=True))
    return _keyed(docs).join(found, ["__id", "__text"], "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the mixture, a row for each copy."""
    return mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near-duplicates", without_near_duplicates),
    ("repeated-passages", without_repeated_passages),
    ("benchmark-leaks", without_leaks),
    ("mixture", mixture),
]

#: SQL can't express the compression classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs

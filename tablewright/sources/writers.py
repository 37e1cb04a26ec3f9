"""Sinks: one table to a new path, or several tables under one base path."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tablewright.columns import exact_names, visible
from tablewright.errors import OperationError
from tablewright.functions.naming import table_name
from tablewright.operators.merging import combine_sheets
from tablewright.operators.roworder import ordered, sort_keys
from tablewright.sources.readers import read_table

SINKS = ("csv", "parquet", "orc", "json")


def result_path(source_path: str, suffix: str = "result", fmt: str | None = None) -> str:
    """A path beside the source, ``<stem>_<suffix>.<format>``, so that the source is never written to."""
    folder, _, last = source_path.rstrip("/").rpartition("/")
    ending = fmt or (last.rpartition(".")[2] if "." in last else "parquet")
    name = f"{table_name(source_path)}_{suffix}.{ending}"
    return f"{folder}/{name}" if folder else name


@exact_names
def write_table(df: DataFrame, path: str, fmt: str | None = None) -> str:
    """Write a table to a path that must not exist yet; row-order columns are dropped.

    A table that was sorted is range-sorted first, so that its files are in order; others are written as
    they lie, without a shuffle.
    """
    kind = fmt or path.rpartition(".")[2]
    if kind not in SINKS:
        raise OperationError(f"Unsupported output format {kind!r}. Use one of: {', '.join(SINKS)}.")
    rows = visible(ordered(df) if sort_keys(df) else df)
    writer = rows.write.mode("errorifexists")
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    try:
        writer.format(kind).save(path)
    except AnalysisException as problem:
        raise OperationError(f"Could not write '{path}': {problem.getCondition()}.") from problem
    return path


MANIFEST = "_manifest"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_tables(tables: Mapping[str, DataFrame], base: str, fmt: str = "parquet") -> dict[str, str]:
    """Write two or more tables kept apart, one folder each under ``base``, which must not exist yet; returns label to path.

    The tables are written beside ``base`` and get their place by one rename at the end, with a manifest of their labels in order. If
    one can't be written, none is there. (A store without a rename of folders copies them, so there the last step takes longer.)
    """
    sheets = combine_sheets(tables)
    base = base.rstrip("/")
    spark = next(iter(sheets.values())).sparkSession
    system, target = _file_system(spark, base)
    if system.exists(target):
        raise OperationError(f"There is already something at '{base}'.")
    stage = f"{base}.{uuid.uuid4().hex}.part"
    _, staged = _file_system(spark, stage)
    try:
        for label, df in sheets.items():
            write_table(df, f"{stage}/{label}", fmt)
        rows = [(i, label, fmt) for i, label in enumerate(sheets)]
        spark.createDataFrame(rows, "place int, label string, format string").coalesce(1).write.json(f"{stage}/{MANIFEST}")
        if not system.rename(staged, target):
            raise OperationError(f"Could not put the tables at '{base}'.")
    except BaseException:
        system.delete(staged, True)
        raise
    return {label: f"{base}/{label}" for label in sheets}


def written_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables that `write_tables` put at ``base``, by label and in their order."""
    base = base.rstrip("/")
    try:
        rows = spark.read.schema("place int, label string, format string").json(f"{base}/{MANIFEST}").orderBy("place").collect()
    except AnalysisException as problem:
        raise OperationError(f"There is no result of several tables at '{base}'.") from problem
    return {r["label"]: read_table(spark, f"{base}/{r['label']}", r["format"]) for r in rows}

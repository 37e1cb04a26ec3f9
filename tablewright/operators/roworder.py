"""Row order.

Spark tables have no row order; first-wins, previous-value and positional operations need one. A table's
order travels with it in hidden columns, all of which sinks drop:

* ``__tw_sort_00_asc``, ``__tw_sort_01_desc``, ... - keys recorded by ``sort``, most significant first;
* ``__tw_key_00_asc``, ... - the group keys of an aggregated table, which is in their order;
* ``__tw_file`` and ``__tw_pos`` - where the row is stored: a file and the row's index in it. The pair is
  the same in every scan, so it is an address;
* ``__tw_seq`` instead of ``__tw_pos`` - a row number that orders rows in one scan but is no address
  (text files and in-memory tables).

Sorting only records keys; no data moves until a limit or a sink asks for the order.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.columns import HIDDEN, col, dtype, exact_names, hidden_columns, replace_columns, require_columns
from tablewright.functions.values import present
from tablewright.operators.asking import asked
from tablewright.session import shared_folder

FILE = HIDDEN + "file"
POS = HIDDEN + "pos"
SEQ = HIDDEN + "seq"
SORT = HIDDEN + "sort_"
GROUP = HIDDEN + "key_"
POSITION = HIDDEN + "position"

# Rows of one stored file that share a block; blocks are what ordered operations work on in parallel.
BLOCK_BITS = 20
# Row numbers of written tables are (partition << 33) + row, as monotonically_increasing_id gives them.
_SEGMENT_BITS = 33


@contextmanager
def _quiet_analysis():
    logger = PySparkLogger.getLogger("DataFrameQueryContextLogger")  # a plain logger of that name would break Spark's own
    before = logger.disabled
    logger.disabled = True
    try:
        yield
    finally:
        logger.disabled = before


def _stored(df: DataFrame, root: str | None) -> DataFrame | None:
    """Add the address of each row when ``df`` comes straight from files, else None."""
    path = F.col("_metadata.file_path")
    if root:
        path = F.substring_index(path, root.rstrip("/"), -1)  # rows carry only what tells files apart
    try:
        with _quiet_analysis():
            return df.select("*", path.alias(FILE), F.col("_metadata.row_index").alias(POS))
    except AnalysisException:
        pass
    try:
        with _quiet_analysis():
            start = F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
            split = F.concat(path, F.lit("\x01"), start)
            return df.select("*", split.alias(FILE), F.monotonically_increasing_id().alias(SEQ))
    except AnalysisException:
        return None


@exact_names
def with_row_order(df: DataFrame, order_by: Sequence[str] | None = None, root: str | None = None) -> DataFrame:
    """Give a table a row order.

    ``order_by`` names the columns that define it (ascending, together unique). Without it the stored
    order is taken: file and row index for files, creation order for in-memory tables. ``root`` is the folder
    or file the table was read from; it shortens the file names that rows carry.
    """
    if order_by:
        require_columns(df, order_by)
        bare = df.drop(*hidden_columns(df))
        keys = {f"{SORT}{i:02d}_asc": present(col(c), dtype(df, c)) for i, c in enumerate(order_by)}
        return replace_columns(bare, keys)
    if hidden_columns(df):
        return df
    stored = _stored(df, root)
    if stored is not None:
        return stored
    return df.select("*", F.lit("").alias(FILE), F.monotonically_increasing_id().alias(SEQ))


def sort_keys(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(SORT))


def order_columns(df: DataFrame) -> list[str]:
    """The hidden columns that define the order, most significant first."""
    groups = sorted(c for c in df.columns if c.startswith(GROUP))
    return sort_keys(df) + groups + [c for c in (FILE, POS, SEQ) if c in df.columns]


def order_terms(df: DataFrame, reverse: bool = False) -> list[Column]:
    """Sort expressions for the table's order; missing keys come last, or first in reverse."""
    terms = []
    for name in order_columns(df):
        c = col(name)
        if name.endswith("_desc") != reverse:
            terms.append(c.desc_nulls_first() if reverse else c.desc_nulls_last())
        else:
            terms.append(c.asc_nulls_first() if reverse else c.asc_nulls_last())
    return terms


@exact_names
def ordered(df: DataFrame) -> DataFrame:
    """The table sorted into its order. The address that ends the key also splits equal sort values over
    several range partitions, so one frequent value does not end up in one task."""
    terms = order_terms(df)
    return df.orderBy(*terms) if terms else df


def scratch_path(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared_folder(spark)}/tablewright-{uuid.uuid4().hex}"


def addressed(df: DataFrame) -> DataFrame:
    """The table with stable row addresses as its only order.

    Stored Parquet rows that were not sorted have them already. Any other table is sorted once and written
    to the shared folder; the row number given while writing is the address from then on, whatever
    executor recomputes what.
    """
    df = with_row_order(df)
    if POS in df.columns and not sort_keys(df):
        return df
    spark = df.sparkSession
    rows = ordered(df).drop(*hidden_columns(df)).withColumn(POS, F.monotonically_increasing_id())

    def written() -> str:
        path = scratch_path(spark)
        rows.write.parquet(path)
        return path

    path = asked(written)
    return spark.read.schema(rows.schema).parquet(path).withColumn(FILE, F.lit(""))


def segment() -> list[Column]:
    """A stored file, or one partition of a written table."""
    return [col(FILE), F.shiftright(col(POS), _SEGMENT_BITS)]


def block(bits: int) -> Column:
    return F.shiftright(col(POS), bits)


def running_total(blocks: DataFrame, size: str, total: str) -> DataFrame:
    """Rows before each block, from a table of ``__tw_file, segment, block, size``.

    The blocks of a segment are summed in parallel; only one row per segment meets in the last step.
    """
    seg = [FILE, "segment"]
    before_seg = (
        blocks.groupBy(*seg)
        .agg(F.sum(size).alias("seg_rows"))
        .withColumn(
            "seg_start",
            F.coalesce(
                F.sum("seg_rows").over(Window.orderBy(*seg).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .drop("seg_rows")
    )
    inside = Window.partitionBy(*seg).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("in_seg", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(before_seg, seg)
        .withColumn(total, F.col("seg_start") + F.col("in_seg"))
        .drop("seg_start", "in_seg", "segment")
    )


def block_starts(df: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per block of an addressed table: ``__tw_file, block, n, start``."""
    file, seg = segment()
    counts = df.groupBy(file.alias(FILE), seg.alias("segment"), block(bits).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return running_total(counts, "n", "start")


@exact_names
def with_positions(df: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``__tw_position``: the dense 0-based position of each row in the table's order.

    Rows are numbered inside blocks, in parallel, and each block is shifted by the rows before it; the
    shuffle by block that the numbering needs is shared with the join.
    """
    base = addressed(df).withColumn("__tw_block", block(bits))
    inside = Window.partitionBy(FILE, "__tw_block").orderBy(POS)
    numbered = base.withColumn("__tw_row", F.row_number().over(inside) - 1)
    starts = block_starts(base, bits).select(FILE, F.col("block").alias("__tw_block"), F.col("start").alias("__tw_start"))
    return (
        numbered.join(starts, [FILE, "__tw_block"])
        .withColumn(POSITION, F.col("__tw_row") + F.col("__tw_start"))
        .drop("__tw_block", "__tw_row", "__tw_start")
    )


@exact_names
def rows_at(df: DataFrame, count: int, from_end: bool = False, bits: int = BLOCK_BITS) -> DataFrame:
    """The first or last ``count`` rows by position. Row counts per block tell which blocks hold them; only
    the block at the border is numbered."""
    base = addressed(df).withColumn("__tw_block", block(bits))
    names = [c for c in base.columns if c != "__tw_block"]
    total = asked(base.count) if from_end else None
    low, high = (total - count, total) if from_end else (0, count)
    first, after = F.col("start"), F.col("start") + F.col("n")
    wanted = (
        block_starts(base, bits)
        .where((after > low) & (first < high))
        .select(
            FILE, F.col("block").alias("__tw_block"), first.alias("__tw_start"),
            ((first >= low) & (after <= high)).alias("__tw_whole"),
        )
    )
    touched = base.join(wanted, [FILE, "__tw_block"])
    inside = Window.partitionBy(FILE, "__tw_block").orderBy(POS)
    position = F.row_number().over(inside) - 1 + F.col("__tw_start")
    border = touched.where(~F.col("__tw_whole")).withColumn(POSITION, position)
    cut = border.where(F.col(POSITION).between(low, high - 1))
    kept = touched.where("__tw_whole")
    return kept.select(*map(col, names)).unionByName(cut.select(*map(col, names)))

"""Sort, first rows, last rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tablewright.columns import col, dtype, exact_names, replace_columns, require_columns
from tablewright.errors import OperationError
from tablewright.functions.dates import to_ts
from tablewright.functions.values import is_text, present, to_num
from tablewright.operators.cutting import first_rows
from tablewright.operators.profiling import require_scalar, sort_meaning
from tablewright.operators.roworder import SORT, order_terms, rows_at, sort_keys, with_row_order

# A top-k of up to TOP_K_DIRECT rows merges one list per partition; up to TOP_K_ROWS - beyond which Spark
# no longer limits groups before a shuffle - groups of partitions are merged first; for larger ones the key is found at which the
# order is cut.
TOP_K_DIRECT = 100
TOP_K_ROWS = 1000
TOP_K_GROUPS = 256


def sort_key(c: Column, t: DataType, meaning: str) -> Column:
    """A key that orders by meaning: numbers as numbers, dates as dates, text without regard to case."""
    if not is_text(t):
        return present(c, t)
    if meaning == "number":
        return to_num(c, t)
    if meaning == "date":
        return to_ts(c, t)
    return F.lower(c)


@exact_names
def sort(
    df: DataFrame,
    columns: Sequence[str],
    orders: Sequence[str] | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Order the table by ``columns``; ``orders`` holds "asc" (default) or "desc" per column.

    Stable, blanks last in both directions. The keys are only recorded: consecutive sorts, and sorts that
    nothing reads, cost no shuffle. ``limit``, ``ordered`` and the sinks apply them.
    """
    if not columns:
        raise OperationError("Name at least one column to sort by.")
    require_columns(df, columns)
    require_scalar(df, columns)
    orders = list(orders or [])
    meanings = sort_meaning(df, columns, types)
    df = with_row_order(df)
    keys: dict[str, Column] = {}
    for i, name in enumerate(columns):
        direction = "desc" if i < len(orders) and orders[i] == "desc" else "asc"
        keys[f"{SORT}{i:02d}_{direction}"] = sort_key(col(name), dtype(df, name), meanings[name])
    earlier = sort_keys(df)
    for i, name in enumerate(earlier, start=len(columns)):
        keys[f"{SORT}{i:02d}_{name.rsplit('_', 1)[1]}"] = col(name)
    stale = [name for name in earlier if name not in keys]
    return replace_columns(df, keys).drop(*stale)


def _positive(count) -> int:
    try:
        count = int(count)
    except (TypeError, ValueError):
        raise OperationError("Give the number of rows to keep as a whole number above zero.") from None
    if count <= 0:
        raise OperationError("The number of rows to keep must be above zero.")
    return count


def _fewer_candidates(df: DataFrame, count: int, reverse: bool) -> DataFrame:
    """Let groups of input partitions settle their own first rows, so that the last step of a top-k does not
    receive ``count`` rows from every partition of a large table."""
    group = F.pmod(F.spark_partition_id(), F.lit(TOP_K_GROUPS)).alias("__tw_group")
    order = Window.partitionBy("__tw_group").orderBy(*order_terms(df, reverse))
    ranked = df.select("*", group).withColumn("__tw_rank", F.row_number().over(order))
    return ranked.where(F.col("__tw_rank") <= count).drop("__tw_group", "__tw_rank")


@exact_names
def limit(df: DataFrame, count: int, from_end: bool = False) -> DataFrame:
    """The first ``count`` rows in the table's order, or the last ones; after ``sort`` this is top-N.

    The result keeps the order's keys, whatever the count. Only a table made in memory is written once, if many rows are asked for,
    as its row numbers may differ from one run to the next.
    """
    count = _positive(count)
    df = with_row_order(df)
    if count > TOP_K_ROWS:
        found = first_rows(df, count, from_end)
        return rows_at(df, count, from_end) if found is None else found
    if count > TOP_K_DIRECT:
        df = _fewer_candidates(df, count, from_end)
    return df.orderBy(*order_terms(df, reverse=from_end)).limit(count)

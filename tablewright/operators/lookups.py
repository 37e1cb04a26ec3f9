"""Lookup: bring one column over from another table by key, first match only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.columns import col, dtype, exact_names, replace_columns, require_columns, visible_columns
from tablewright.errors import OperationError
from tablewright.functions.values import is_blank, norm_key, number_text, present
from tablewright.operators.asking import asked
from tablewright.operators.duplicates import first_per_key
from tablewright.operators.profiling import require_scalar
from tablewright.operators.roworder import addressed, order_columns, with_row_order

# Fixed value: what an unmatched row shows.
NOT_FOUND = "Not found"

# A source whose keys and values measure at most this much is sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 64

# Every key with more rows than this, or than one in HOT_SHARE of all rows, is split over tasks, one salt per so many rows. So there
# are at most HOT_SHARE such keys, however large the table is, and their list can be sent to every task.
HOT_ROWS = 1_000_000
HOT_SHARE = 100_000

KEY = "__tw_key"
VALUE = "__tw_value"
_SALT = "__tw_salt"
_SALTS = "__tw_salts"


def check_lookup(df: DataFrame, source: DataFrame, key_column, source_key_column, return_column) -> None:
    if not (key_column and source_key_column and return_column):
        raise OperationError("A lookup needs a key column, the source's key column and the column to bring back.")
    require_columns(df, [key_column])
    absent = [c for c in (source_key_column, return_column) if c not in visible_columns(source)]
    if absent:
        raise OperationError(
            f"The source table has no column {', '.join(map(repr, absent))}. It has: {', '.join(visible_columns(source))}."
        )
    require_scalar(df, [key_column])
    require_scalar(source, [source_key_column])


def _keyed_source(source: DataFrame, source_key_column: str, return_column: str) -> DataFrame:
    """Keys, values and row order of the source; blank keys never match and are left out."""
    source = with_row_order(source)
    key, value = col(source_key_column), col(return_column)
    t = dtype(source, source_key_column)
    return source.where(~is_blank(key, t)).select(
        norm_key(key, t).alias(KEY),
        present(value, dtype(source, return_column)).alias(VALUE),
        *[col(c) for c in order_columns(source)],
    )


def _measured_bytes(source: DataFrame) -> int:
    size = F.octet_length(KEY) + F.coalesce(F.octet_length(F.col(VALUE).cast("string")), F.lit(0)) + ROW_OVERHEAD
    return asked(lambda: source.agg(F.sum(size.cast("bigint"))).first()[0]) or 0


def _salted_join(left: DataFrame, first: DataFrame, hot_rows: int, no_key: Column) -> DataFrame:
    """Shuffle join in which the rows of frequent keys are spread over many tasks.

    Every salt of a frequent key has its copy of the key's one source row, so the result is the same. Rows without a key match
    nothing; they stay out of the join and are not shuffled. ``no_key`` finds them by the cell, as a filter would spell the key anew.
    """
    keyed = left.where(~no_key)
    counts = keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    total = asked(lambda: counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    each = max(hot_rows, total // HOT_SHARE)
    hot = counts.where(F.col("n") > each).select(KEY, F.floor(F.col("n") / each + 1).cast("bigint").alias(_SALTS))
    salts = F.coalesce(F.col(_SALTS), F.lit(1).cast("bigint"))
    spread = F.xxhash64(*[col(c) for c in order_columns(left)])
    keyed = keyed.join(F.broadcast(hot), KEY, "left").withColumn(_SALT, F.pmod(spread, salts)).drop(_SALTS)
    right = first.join(F.broadcast(hot), KEY, "left")
    right = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop(_SALTS)
    joined = keyed.join(right.hint("merge"), [KEY, _SALT], "left").drop(_SALT)
    alone = left.where(no_key).drop(KEY).withColumn(KEY, F.lit(None).cast("string")).withColumn(VALUE, F.lit(None).cast(dtype(first, VALUE)))
    return joined.unionByName(alone)


@exact_names
def match_first(
    df: DataFrame,
    source: DataFrame,
    key_column: str,
    source_key_column: str,
    return_column: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``df`` with the value of the first source row of the same key in ``__tw_value``.

    Keys match without regard to case, outer white space, or number against text. The size of the source is
    measured first: a small one is broadcast and ``df`` is not shuffled at all, a large one is joined by a
    salted shuffle.
    """
    check_lookup(df, source, key_column, source_key_column, return_column)
    if df.isStreaming:
        source = addressed(source)  # every micro-batch must see the same first rows
    keyed = _keyed_source(source, source_key_column, return_column)
    first = first_per_key(keyed, [F.col(KEY)]).select(KEY, VALUE)
    left_type = dtype(df, key_column)
    key = F.when(~is_blank(col(key_column), left_type), norm_key(col(key_column), left_type))
    if df.isStreaming:
        joined = df.withColumn(KEY, key).join(first, KEY, "left")
    elif _measured_bytes(keyed) <= broadcast_bytes:
        joined = df.withColumn(KEY, key).join(F.broadcast(first), KEY, "left")
    else:
        joined = _salted_join(with_row_order(df).withColumn(KEY, key), first, hot_rows, is_blank(col(key_column), left_type))
    return joined.select(*[col(c) for c in df.columns], VALUE)


@exact_names
def lookup(
    df: DataFrame,
    source: DataFrame,
    key_column: str,
    source_key_column: str,
    return_column: str,
    new_column: str | None = None,
    not_found: str | None = NOT_FOUND,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``new_column`` (default: the name of ``return_column``) with the looked-up value of each row.

    Rows and their order stay. Unmatched rows show ``not_found``, which makes the column text; with
    ``not_found=None`` they are NULL and the column keeps its type. A column of that name is replaced.
    """
    joined = match_first(df, source, key_column, source_key_column, return_column, broadcast_bytes, hot_rows)
    return shown(joined, new_column or return_column, not_found)


def shown(matched: DataFrame, new_column: str, not_found: str | None = NOT_FOUND) -> DataFrame:
    """The outcome of :func:`match_first` as a named column."""
    value = F.col(VALUE)
    if not_found is not None:
        value = F.coalesce(number_text(value, dtype(matched, VALUE)), F.lit(not_found))
    return replace_columns(matched, {new_column: value}).drop(VALUE)


"""Duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.columns import col, dtype, exact_names, visible_columns
from tablewright.errors import OperationError
from tablewright.functions.values import norm_dup
from tablewright.operators.profiling import chosen_columns
from tablewright.operators.roworder import order_terms, with_row_order

RANK = "__tw_rank"


def first_per_key(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """The first row, in the table's order, of each key.

    Catalyst turns the rank filter into a group limit that runs before the shuffle as well: each task sends
    at most one row per key, however many copies a key has.
    """
    ranked = df.withColumn(RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_terms(df))))
    return ranked.where(F.col(RANK) == 1).drop(RANK)


@exact_names
def remove_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row of each key, with its original spelling.

    Text keys ignore case and outer white space; missing cells are equal to each other. All columns form
    the key by default; nested ones are compared as they are.
    """
    df = with_row_order(df)
    names = chosen_columns(df, columns) if columns else visible_columns(df)
    maps = [c for c in names if "map<" in dtype(df, c).simpleString()]
    if maps:
        raise OperationError(f"Maps can't be compared: {', '.join(maps)}. Name the columns that tell rows apart.")
    return first_per_key(df, [norm_dup(col(c), dtype(df, c)) for c in names])

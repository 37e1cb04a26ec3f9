"""Keep, remove and rename columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablewright.columns import col, exact_names, hidden_columns, require_columns, visible_columns
from tablewright.errors import OperationError


@exact_names
def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep only ``columns``, in the given order."""
    if not columns:
        raise OperationError("Name the columns to keep.")
    require_columns(df, columns)
    if len(set(columns)) != len(columns):
        raise OperationError("A column can be kept only once.")
    return df.select(*[col(c) for c in [*columns, *hidden_columns(df)]])


@exact_names
def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        raise OperationError("Name the columns to remove.")
    require_columns(df, columns)
    return df.select(*[col(c) for c in df.columns if c not in columns])


@exact_names
def rename_columns(df: DataFrame, rename_from: Sequence[str], rename_to: Sequence[str]) -> DataFrame:
    """Rename columns given as two parallel lists. Two columns may not end up with one name."""
    if not rename_from or len(rename_from) != len(rename_to or []):
        raise OperationError("Give as many new names as old names.")
    require_columns(df, rename_from)
    new = dict(zip(rename_from, rename_to))
    names = [new.get(c, c) for c in visible_columns(df)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise OperationError(f"Renaming would give two columns the name {', '.join(map(repr, twice))}.")
    return df.select(*[col(c).alias(new[c]) if c in new else col(c) for c in df.columns])



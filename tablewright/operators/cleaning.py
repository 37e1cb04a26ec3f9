"""Trim, find and replace, drop invalid values."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.columns import col, dtype, exact_names, replace_columns, require_columns
from tablewright.errors import OperationError
from tablewright.functions.dates import to_ts
from tablewright.functions.values import WHITESPACE_RUN, is_blank, is_text, number_text, once, to_num, trim_ws
from tablewright.operators.asking import asked
from tablewright.operators.profiling import require_scalar, text_columns
from tablewright.operators.roworder import order_columns


def trimmed(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, WHITESPACE_RUN, " "))


def trim_targets(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    require_columns(df, columns or [])
    return [c for c in text_columns(df) if not columns or c in columns]


@exact_names
def trim(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip outer white space and collapse inner runs to one space, in text columns only."""
    return replace_columns(df, {c: trimmed(col(c)) for c in trim_targets(df, columns)})


def _java_literal(text: str) -> str:
    """``text`` as a regular expression that matches it literally."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def replacement(c: Column, find: str, replace: str, match_case: bool, whole_cell: bool) -> tuple[Column, Column]:
    """The text cell after replacement, and whether it matched at all."""
    if whole_cell:
        cell, wanted = trim_ws(c), find.strip()
        hit = cell == wanted if match_case else F.lower(cell) == wanted.lower()
        return F.when(hit, F.lit(replace)).otherwise(c), hit
    if match_case:
        return F.replace(c, F.lit(find), F.lit(replace)), c.contains(find)
    pattern = "(?iu)" + _java_literal(find)
    quoted = replace.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, pattern, quoted), c.rlike(pattern)


def replace_targets(df: DataFrame, find: str, column: str | None) -> list[str]:
    if not find:
        raise OperationError("Say which text to find.")
    if not column:
        return text_columns(df)
    require_columns(df, [column])
    require_scalar(df, [column])
    return [column]


@exact_names
def find_replace(
    df: DataFrame,
    find: str,
    replace: str | None = "",
    column: str | None = None,
    match_case: bool = False,
    whole_cell: bool = False,
) -> DataFrame:
    """Replace literal text inside cells, or whole cells that equal it but for outer white space.

    Without ``column`` all text columns are searched. A named column of another type is compared as text
    and becomes text if any of its cells matches.
    """
    new: dict[str, Column] = {}
    for name in replace_targets(df, find, column):
        text = number_text(col(name), dtype(df, name), keep_point=True)
        cell, hit = replacement(text, find, replace or "", match_case, whole_cell)
        if is_text(dtype(df, name)) or not asked(df.where(hit).isEmpty):
            new[name] = cell
    return replace_columns(df, new)


def invalid(df: DataFrame, name: str, kind: str) -> Column:
    """The cell holds something that is not a number (or date). Typed columns hold no invalid cells."""
    c, t = col(name), dtype(df, name)
    if not is_text(t):
        return F.lit(False)
    read = once(c, lambda cell: to_ts(cell, t)) if kind == "date" else to_num(c, t)
    return ~is_blank(c, t) & read.isNull()


def invalid_kind(data_type: str | None) -> str:
    return "date" if (data_type or "").lower() == "date" else "number"


@exact_names
def drop_invalid(df: DataFrame, columns: Sequence[str], data_type: str | None = "number") -> DataFrame:
    """Drop the rows with a cell in ``columns`` that is filled but not a valid number (or "date")."""
    if not columns:
        raise OperationError("Name the columns to check for invalid values.")
    require_columns(df, columns)
    require_scalar(df, columns)
    return df.where(~reduce(operator.or_, [invalid(df, c, invalid_kind(data_type)) for c in columns]))


@exact_names
def offenders(df: DataFrame, name: str, kind: str = "number", count: int = 5) -> DataFrame:
    """Up to ``count`` distinct invalid values of a column, in the order they first appear."""
    bad = df.where(invalid(df, name, kind))
    place = [col(c) for c in order_columns(df)] or [F.lit(0)]
    found = bad.groupBy(col(name).alias("value")).agg(F.min(F.struct(*place)).alias("first"))
    return found.orderBy("first", "value").limit(count).select("value")

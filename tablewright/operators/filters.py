"""Row filters: 14 predicates that read messy cells by meaning, joined by AND or OR.

Predicates on typed columns compare the column itself with a typed literal, so they are pushed into the
scan. A missing cell satisfies ``not_equals`` and ``not_in`` and no other comparison.
"""

from __future__ import annotations

import operator as op
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tablewright.columns import col, dtype, exact_names, require_columns
from tablewright.errors import OperationError
from tablewright.functions.dates import date_literal, parse_date, to_ts
from tablewright.functions.values import (
    is_blank,
    is_fractional,
    is_number,
    is_temporal,
    is_text,
    norm_key,
    norm_literal,
    number_literal,
    number_text,
    once,
    parse_number,
    to_num,
)
from tablewright.operators.profiling import have_dates, have_numbers, require_scalar

# The predicate names of the plan vocabulary.
BLANK_TESTS = ("is_blank", "not_blank")
KEY_TESTS = ("equals", "not_equals", "in", "not_in")
TEXT_TESTS = ("contains", "starts_with", "ends_with")
RANGE_TESTS = ("greater_than", "less_than", "greater_or_equal", "less_or_equal", "between")

_COMPARE = {
    "greater_than": op.gt,
    "less_than": op.lt,
    "greater_or_equal": op.ge,
    "less_or_equal": op.le,
}


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: object = None
    value2: object = None  # second bound of ``between``
    values: Sequence | None = None  # members of ``in`` and ``not_in``

    @classmethod
    def of(cls, given: Condition | Mapping) -> Condition:
        if isinstance(given, Condition):
            return given
        if not given.get("column"):
            raise OperationError("Every filter condition needs a column.")
        fields = ("column", "value", "value2", "values")
        return cls(operator=(given.get("operator") or "").lower(), **{k: given.get(k) for k in fields})


@dataclass(frozen=True)
class Kinds:
    """Which of the columns under a range test hold numbers, and which hold dates."""

    numbers: Mapping[str, bool]
    dates: Mapping[str, bool]


def _member(c: Column, t: DataType, values: Sequence) -> Column:
    """The cell equals one of ``values`` as a key. NULL for a missing cell."""
    values = [v for v in values if v is not None]
    if is_number(t):
        wanted = [number_literal(n) for n in map(parse_number, values) if n is not None]
    elif is_temporal(t):
        wanted = [date_literal(d, t) for d in map(parse_date, values) if d is not None]
    else:
        c, wanted = norm_key(c, t), [F.lit(norm_literal(v)) for v in values]
    if not wanted:
        return F.lit(False)
    return c == wanted[0] if len(wanted) == 1 else c.isin(*wanted)


def _key_test(cond: Condition, c: Column, t: DataType) -> Column:
    if cond.operator in ("in", "not_in"):
        values = list(cond.values or ([] if cond.value is None else [cond.value]))
        if not values:
            raise OperationError(f"'{cond.operator}' on {cond.column} needs a list of values.")
    else:
        values = [cond.value]
    found = _member(c, t, values)
    return ~F.coalesce(found, F.lit(False)) if cond.operator.startswith("not_") else found


def _text_test(cond: Condition, c: Column, t: DataType) -> Column:
    if cond.value is None:
        raise OperationError(f"'{cond.operator}' on {cond.column} needs a value.")
    cell, wanted = F.lower(number_text(c, t, keep_point=True)), str(cond.value).lower()
    if cond.operator == "contains":
        return cell.contains(wanted)
    return cell.startswith(wanted) if cond.operator == "starts_with" else cell.endswith(wanted)


def _bounds(cond: Condition) -> list:
    return [cond.value, cond.value2] if cond.operator == "between" else [cond.value]


def _numbers(cond: Condition) -> list[int | float] | None:
    numbers = [parse_number(v) for v in _bounds(cond)]
    return None if None in numbers else numbers


def has_number_bounds(cond: Condition) -> bool:
    return _numbers(cond) is not None


def _comparable(cond: Condition, c: Column, t: DataType, kinds: Kinds) -> tuple[Column, list, bool]:
    """The cell and the given bounds in one comparable kind; the last item tells dates from numbers."""
    numbers = _numbers(cond)
    if numbers is not None and kinds.numbers.get(cond.column):
        return (c if is_number(t) else to_num(c, t)), numbers, False
    if kinds.dates.get(cond.column):
        dates = [parse_date(v) for v in _bounds(cond)]
        if None in dates:
            raise OperationError(f"Could not read a date to compare with '{cond.column}'.")
        return (once(c, lambda cell: to_ts(cell, t)) if is_text(t) else c), dates, True
    raise OperationError(f"'{cond.column}' can't be compared with {cond.value!r}: they are not numbers or dates alike.")


def _range_test(cond: Condition, c: Column, t: DataType, kinds: Kinds) -> Column:
    cell, bounds, temporal = _comparable(cond, c, t, kinds)
    literal = (lambda b: date_literal(b, t)) if temporal else number_literal
    if cond.operator == "between":
        low, high = sorted(bounds)
        found = (cell >= literal(low)) & (cell <= literal(high))
    else:
        found = _COMPARE[cond.operator](cell, literal(bounds[0]))
    if is_fractional(t) and cond.operator.startswith("greater"):
        found = found & ~F.isnan(cell)  # NaN is a missing cell, but it sorts above every number
    # Text is read once per row: without coalesce the optimizer adds a null test that reads it again.
    return F.coalesce(found, F.lit(False)) if is_text(t) else found


def predicate(df: DataFrame, cond: Condition, kinds: Kinds) -> Column:
    """The condition as a boolean column; NULL stands for False."""
    c, t = col(cond.column), dtype(df, cond.column)
    if cond.operator in BLANK_TESTS:
        return is_blank(c, t) if cond.operator == "is_blank" else ~is_blank(c, t)
    if cond.operator in KEY_TESTS:
        return _key_test(cond, c, t)
    if cond.operator in TEXT_TESTS:
        return _text_test(cond, c, t)
    if cond.operator in RANGE_TESTS:
        return _range_test(cond, c, t, kinds)
    raise OperationError(f"Unknown filter operator: {cond.operator!r}.")


def filter_predicate(
    df: DataFrame,
    conditions: Sequence[Condition | Mapping],
    combine: str | None = "and",
    types: Mapping[str, str] | None = None,
) -> Column:
    """All conditions joined by ``combine`` ("and" or "or"), as one boolean column."""
    if not conditions:
        raise OperationError("A filter needs at least one condition.")
    conditions = [Condition.of(c) for c in conditions]
    names = [c.column for c in conditions]
    require_columns(df, names)
    require_scalar(df, names)
    ranges = [c for c in conditions if c.operator in RANGE_TESTS]
    numbers = have_numbers(df, [c.column for c in ranges if _numbers(c) is not None], types)
    rest = [c.column for c in ranges if _numbers(c) is None or not numbers[c.column]]
    kinds = Kinds(numbers, have_dates(df, rest, types))
    join = op.or_ if (combine or "and").lower() == "or" else op.and_
    return reduce(join, [predicate(df, c, kinds) for c in conditions])


@exact_names
def filter_rows(
    df: DataFrame,
    conditions: Sequence[Condition | Mapping],
    combine: str | None = "and",
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Keep the rows that satisfy the conditions."""
    return df.where(filter_predicate(df, conditions, combine, types))

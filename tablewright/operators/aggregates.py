"""Aggregates: sum, average, min, max and count, for the whole table or per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.columns import col, dtype, exact_names, require_columns
from tablewright.errors import OperationError
from tablewright.functions.values import (
    is_blank,
    is_integral,
    is_temporal,
    is_text,
    norm_key,
    norm_literal,
    present,
    to_num,
)
from tablewright.operators.cleaning import invalid, offenders
from tablewright.operators.profiling import have_numbers, require_scalar
from tablewright.operators.roworder import GROUP

# Accepted spellings of the five functions, the words used in labels, the label of no group.
SPELLINGS = {"sum": "sum", "mean": "mean", "average": "mean", "avg": "mean", "count": "count", "min": "min", "max": "max"}
WORDS = {"mean": "average"}
BLANK_GROUP = "(blank)"


@dataclass(frozen=True)
class Aggregate:
    """A checked request: ``expression`` computes it, ``label`` names the result column."""

    func: str
    column: str | None
    count_value: object
    label: str

    @property
    def word(self) -> str:
        return WORDS.get(self.func, self.func)


def check_aggregate(
    df: DataFrame, agg_func: str | None, agg_column: str | None, group_by: Sequence[str], count_value
) -> Aggregate:
    func = SPELLINGS.get((agg_func or "").lower())
    if func is None:
        raise OperationError(f"{agg_func!r} is not one of sum, average, count, min and max.")
    word = WORDS.get(func, func)
    if agg_column is None and (func != "count" or count_value is not None):
        raise OperationError(f"Name the column to {'search' if count_value is not None else f'take the {word} of'}.")
    names = [*group_by, *([agg_column] if agg_column else [])]
    require_columns(df, names)
    require_scalar(df, names)
    if func in ("sum", "mean") and is_temporal(dtype(df, agg_column)):
        raise OperationError(f"Can't {word} '{agg_column}': it holds dates.")
    if count_value is not None and func == "count":
        label = f"count_of_{count_value}"
    else:
        label = f"{word}_of_{agg_column}" if agg_column else "count"
    return Aggregate(func, agg_column, count_value, label)


def _number(df: DataFrame, name: str) -> Column:
    t = dtype(df, name)
    return col(name) if is_temporal(t) else to_num(col(name), t)


def _matches(df: DataFrame, spec: Aggregate) -> Column:
    return norm_key(col(spec.column), dtype(df, spec.column)) == F.lit(norm_literal(spec.count_value))


def _measure(df: DataFrame, spec: Aggregate) -> Column:
    """The aggregate of a numeric function over the cells that are numbers."""
    cell = _number(df, spec.column)
    if spec.func == "sum" and is_integral(dtype(df, spec.column)):
        return F.try_sum(cell)  # NULL instead of a failing job when a bigint total overflows
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[spec.func](cell)


def _require_numbers(df: DataFrame, spec: Aggregate, types: Mapping[str, str] | None) -> None:
    if spec.func != "count" and is_text(dtype(df, spec.column)):
        if not have_numbers(df, [spec.column], types)[spec.column]:
            raise OperationError(f"Can't take the {spec.word} of '{spec.column}': it holds text, not numbers.")


@exact_names
def aggregate_by(
    df: DataFrame,
    agg_func: str,
    agg_column: str | None = None,
    *,
    group_by: Sequence[str],
    count_value=None,
    label_blank: bool = False,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per group: the group columns and ``<func>_of_<column>``.

    Partial aggregation runs before the shuffle, so a frequent group costs one row per task. Rows without
    a group form the group ``(blank)`` in text columns; other types keep NULL unless ``label_blank``.
    Counting a value keeps only the groups in which it occurs. The groups are in the order of their keys
    for operations that need an order; nothing is sorted for that.
    """
    spec = check_aggregate(df, agg_func, agg_column, group_by, count_value)
    _require_numbers(df, spec, types)
    if spec.label in group_by or len(set(group_by)) < len(list(group_by)):
        raise OperationError(f"Group columns must differ from each other and from the result, '{spec.label}'.")
    if spec.func == "count":
        rows = df.where(_matches(df, spec)) if count_value is not None else df
        measure = F.count(F.lit(1))
    else:
        rows, measure = df, _measure(df, spec)

    def label(name: str) -> Column:
        if is_text(dtype(df, name)) or label_blank:
            return F.coalesce(col(name).cast("string"), F.lit(BLANK_GROUP)).alias(name)
        return col(name)

    grouped = rows.groupBy(*[col(g) for g in group_by]).agg(measure.alias(spec.label))
    order = [present(col(g), dtype(df, g)).alias(f"{GROUP}{i:02d}_asc") for i, g in enumerate(group_by)]
    return grouped.select(*[label(g) for g in group_by], col(spec.label), *order)


def scalar_measure(df: DataFrame, spec: Aggregate) -> Column:
    if spec.func != "count":
        return _measure(df, spec)
    if spec.count_value is not None:
        return F.count_if(_matches(df, spec))
    if spec.column:
        return F.count_if(~is_blank(col(spec.column), dtype(df, spec.column)))
    return F.count(F.lit(1))


def ignored_measure(df: DataFrame, spec: Aggregate) -> Column:
    """Cells left out of the computation: blanks, and for numeric functions everything that is no number."""
    if not spec.column or (spec.func == "count" and spec.count_value is not None):
        return F.lit(0).cast("bigint")
    if spec.func == "count":
        return F.count_if(is_blank(col(spec.column), dtype(df, spec.column)))
    return F.count_if(_number(df, spec.column).isNull())


@exact_names
def aggregate_table(
    df: DataFrame,
    agg_func: str,
    agg_column: str | None = None,
    *,
    count_value=None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """The answer for the whole table as a table of one row."""
    spec = check_aggregate(df, agg_func, agg_column, (), count_value)
    _require_numbers(df, spec, types)
    return df.agg(scalar_measure(df, spec).alias(spec.label))


def tidy(value) -> str:
    """A computed value for display: whole numbers plain, others to two decimals."""
    if value is None:
        return "0"
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        number = float(value)
        return str(int(value)) if number.is_integer() else str(round(number, 2))
    return str(value)


@dataclass(frozen=True)
class ScalarAnswer:
    label: str
    value: object
    ignored: int
    offenders: list[str]
    message: str


@exact_names
def aggregate_answer(
    df: DataFrame,
    agg_func: str,
    agg_column: str | None = None,
    *,
    count_value=None,
    types: Mapping[str, str] | None = None,
) -> ScalarAnswer:
    """Compute the answer for the whole table, with what was left out: value and counts in one pass, and
    up to five distinct values that are not numbers when there are any."""
    spec = check_aggregate(df, agg_func, agg_column, (), count_value)
    numeric = spec.func != "count"
    wrong = invalid(df, spec.column, "number") if numeric else F.lit(False)
    row = df.agg(
        scalar_measure(df, spec).alias("value"),
        ignored_measure(df, spec).alias("ignored"),
        F.count_if(wrong).alias("wrong"),
        (F.count(_number(df, spec.column)) if numeric else F.lit(0)).alias("numbers"),
    ).first()
    if numeric and is_text(dtype(df, spec.column)) and not row["numbers"]:
        raise OperationError(f"Can't take the {spec.word} of '{spec.column}': it holds text, not numbers.")
    named = [r["value"] for r in offenders(df, spec.column).collect()] if row["wrong"] else []
    of = f" of '{spec.count_value}' in '{spec.column}'" if count_value is not None else ""
    of = of or (f" of '{spec.column}'" if spec.column else "")
    message = f"The {spec.word}{of} is {tidy(row['value'])}."
    if row["ignored"]:
        kind = "blank or non-numeric" if numeric else "blank"
        examples = f", among them {', '.join(map(repr, named))}" if named else ""
        message += f" It leaves out {row['ignored']} {kind} cell{'s' if row['ignored'] != 1 else ''}{examples}."
    return ScalarAnswer(spec.label, row["value"], row["ignored"], named, message)


@exact_names
def aggregate_report(
    df: DataFrame,
    agg_func: str,
    agg_column: str | None = None,
    *,
    count_value=None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """The answer and the number of cells left out, as a table of one row ``value, ignored_cells``."""
    spec = check_aggregate(df, agg_func, agg_column, (), count_value)
    _require_numbers(df, spec, types)
    return df.agg(scalar_measure(df, spec).alias("value"), ignored_measure(df, spec).alias("ignored_cells"))

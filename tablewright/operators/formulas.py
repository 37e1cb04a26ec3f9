"""Computed columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tablewright.columns import col, dtype, exact_names, replace_columns, require_columns, visible_columns
from tablewright.errors import OperationError
from tablewright.functions.formula import MAX_EXPONENT, MAX_LENGTH, Formula, Term, is_plain, placeholders, translate
from tablewright.functions.values import is_integral, is_temporal, is_text, to_num
from tablewright.operators.asking import asked
from tablewright.operators.profiling import number_like, require_scalar


def _any(df: DataFrame, test: Column) -> bool:
    return bool(df.agg(F.coalesce(F.bool_or(test), F.lit(False))).first()[0])


@exact_names
def build_formula(df: DataFrame, formula: str, types: Mapping[str, str] | None = None) -> Formula:
    """Translate a formula against a table, after checking on the data what the rules depend on."""
    if len(formula) > MAX_LENGTH:
        raise OperationError(f"A formula may have at most {MAX_LENGTH} characters.")
    names = placeholders(formula)
    require_columns(df, names)
    require_scalar(df, names)
    numeric = number_like(df, names, types)
    if is_plain(formula):
        words = [n for n in names if not numeric[n]]
        if words:
            raise OperationError(f"A formula needs numbers, and these columns hold something else: {', '.join(words)}.")

    def resolve(name: str, whole: str = "bigint") -> Term:
        c, t = col(name), dtype(df, name)
        if numeric[name]:
            return Term(to_num(c, t).cast("double"), "number", whole=c.cast(whole) if is_integral(t) else None, counted=True)
        if is_temporal(t):
            return Term(c.cast("timestamp_ntz"), "date")
        return Term(c if is_text(t) else c.cast("string"), "text")

    built = translate(formula, resolve)
    if built.is_whole and built.grows and any(isinstance(dtype(df, n), LongType) for n in names):
        # Only long columns can outgrow 64 bits in a formula of this length, and they seldom do: one look tells.
        wide = translate(formula, lambda name: resolve(name, "decimal(38,0)"), wide=True)
        outgrown = built.column.isNull() & wide.column.isNotNull()
        if not df.isStreaming and asked(lambda: _any(df, outgrown)):
            built = wide
    if built.exponents:
        sizes = F.max(F.greatest(F.lit(0.0), *[F.abs(e) for e in built.exponents]))
        largest = asked(lambda: df.agg(sizes).first()[0])
        if largest is not None and largest > MAX_EXPONENT:
            raise OperationError(f"Powers above {MAX_EXPONENT} are not supported.")
    return built


def check_target(df: DataFrame, name: str | None, formula: str | None, overwrite: bool) -> str:
    name = (name or "").strip()
    if not name:
        raise OperationError("The new column needs a name.")
    if not formula:
        raise OperationError(f"Column '{name}' needs a formula.")
    require_columns(df, placeholders(formula))
    if name in visible_columns(df) and not overwrite:
        raise OperationError(f"There is already a column '{name}'. Choose another name or overwrite it.")
    return name


@exact_names
def add_formula_column(
    df: DataFrame,
    name: str,
    formula: str,
    overwrite: bool = False,
    types: Mapping[str, str] | None = None,
    div_zero: str = "ieee",
) -> DataFrame:
    """Add column ``name`` computed per row, e.g. ``{Qty} * {Price}`` or ``IF({Qty} > 2, "many", "few")``.

    Supports ``+ - * / % **``, comparisons, ``and``/``or``, and IF ABS SQRT INT ROUND SUM AVERAGE MIN MAX
    over the cells of a row. Sums, differences, products, remainders and roundings of whole columns stay whole and exact; where some
    result outgrows 64 bits the column is a decimal of 38 digits. x/0 gives an infinity; ``div_zero="null"`` gives NULL for it and for NaN.
    """
    target = check_target(df, name, formula, overwrite)
    built = build_formula(df, formula, types)
    value = built.column
    if div_zero == "null" and built.term.kind == "number" and not built.is_whole:
        value = F.when(F.abs(value) < float("inf"), value)
    return replace_columns(df, {target: value.cast("string") if built.term.kind == "null" else value})

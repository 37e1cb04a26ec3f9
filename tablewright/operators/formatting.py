"""Display formats. A table has no cell styles, so each formatted column gets a text column beside it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.columns import col, dtype, exact_names, replace_columns, require_columns
from tablewright.errors import OperationError
from tablewright.functions.dates import to_ts
from tablewright.functions.display import shown_date, shown_number
from tablewright.functions.values import number_text, to_num
from tablewright.operators.asking import asked
from tablewright.operators.profiling import have_dates, have_numbers, require_scalar

# The formats, and what their columns should hold.
FORMATS = {"number": "numbers", "currency": "numbers", "percent": "numbers", "date": "dates"}


def check_format(df: DataFrame, columns: Sequence[str] | None, number_format: str | None, bold_header: bool = False):
    if not columns:
        if not bold_header:
            raise OperationError("Name the columns to format.")
        return
    require_columns(df, columns)
    require_scalar(df, columns)
    if not number_format:
        raise OperationError("Choose a format: number, currency, percent or date.")


@exact_names
def format_cells(
    df: DataFrame,
    format_columns: Sequence[str] | None,
    number_format: str | None = None,
    decimals: int | None = None,
    currency_symbol: str | None = None,
    date_format: str | None = None,
    bold_header: bool = False,
) -> DataFrame:
    """Add ``<column>_display`` for each column; the values themselves stay as they are.

    A cell that doesn't hold what the format shows is displayed as it is. A bold header is presentation
    without data and leaves the table unchanged.
    """
    check_format(df, format_columns, number_format, bold_header)
    shown = {}
    for name in format_columns or []:
        c, t = col(name), dtype(df, name)
        if number_format == "date":
            text = shown_date(to_ts(c, t), date_format)
        elif number_format in FORMATS:
            text = shown_number(to_num(c, t), number_format, decimals, currency_symbol)
        else:
            text = F.lit(None).cast("string")
        shown[f"{name}_display"] = F.coalesce(text, number_text(c, t))
    return replace_columns(df, shown)


@exact_names
def format_mismatches(
    df: DataFrame, columns: Sequence[str], number_format: str, types: Mapping[str, str] | None = None
) -> list[str]:
    """The columns in which nothing fits the format; worth a warning, not an error. Empty columns are fine."""
    if number_format not in FORMATS:
        return []
    fits = (have_dates if number_format == "date" else have_numbers)(df, columns, types)
    unfit = [c for c in columns if not fits[c]]
    return unfit if unfit and not asked(df.isEmpty) else []

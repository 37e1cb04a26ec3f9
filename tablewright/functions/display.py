"""Cells as they are shown: number, currency, percent and date formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default currency sign, the named date styles and the style used for anything else.
CURRENCY = "₹"
DATE_STYLES = (
    "dd-mm-yyyy",
    "mm-dd-yyyy",
    "yyyy-mm-dd",
    "dd/mm/yyyy",
    "mm/dd/yyyy",
    "dd-mmm-yyyy",
    "d mmmm yyyy",
    "mmmm d, yyyy",
)
DEFAULT_DATE_STYLE = "dd-mm-yyyy"
_OWN_STYLE = r"[dmyDMY/\-. ,]+"


def date_pattern(style: str | None) -> str:
    """The Spark pattern of a named date style or of one spelled with d, m, y and separators."""
    style = (style or DEFAULT_DATE_STYLE).strip().lower()
    if style not in DATE_STYLES and not re.fullmatch(_OWN_STYLE, style):
        style = DEFAULT_DATE_STYLE

    def run(letters: re.Match) -> str:
        text = letters[0]
        if text[0] == "m":
            return "M" * min(len(text), 5)
        if text[0] == "y":
            return "yy" if len(text) <= 2 else "yyyy"
        return text if len(text) <= 2 else "E" * min(len(text), 4)

    return re.sub(r"d+|m+|y+", run, style)


def shown_number(c: Column, kind: str, decimals: int | None = None, symbol: str | None = None) -> Column:
    """A number with thousands separators, a currency sign before its digits, or as a percentage."""
    places = decimals if isinstance(decimals, int) and not isinstance(decimals, bool) and decimals >= 0 else 2
    c = c.cast("double")
    if kind == "percent":
        return F.concat(F.replace(F.format_number(c * 100, places), F.lit(","), F.lit("")), F.lit("%"))
    digits = F.format_number(F.abs(c), places)
    if kind == "currency":
        digits = F.concat(F.lit(symbol or CURRENCY), digits)
    return F.when(c < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def shown_date(c: Column, style: str | None = None) -> Column:
    return F.date_format(c, date_pattern(style))

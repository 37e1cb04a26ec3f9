"""Scalar meaning of a cell: blank, number, comparison key. Pure ``Column -> Column`` builders."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    FloatType,
    IntegralType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

# The characters that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# Fixed value: what text is a number. Guards the cast, which would also take '12D', '1f' or '0x1p3'.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def is_text(t: DataType) -> bool:
    return isinstance(t, StringType)


def is_fractional(t: DataType) -> bool:
    return isinstance(t, (DoubleType, FloatType))


def is_number(t: DataType) -> bool:
    return isinstance(t, NumericType)


def is_integral(t: DataType) -> bool:
    return isinstance(t, IntegralType)


def is_temporal(t: DataType) -> bool:
    return isinstance(t, (DateType, TimestampType, TimestampNTZType))


def is_scalar(t: DataType) -> bool:
    return isinstance(t, BooleanType) or is_text(t) or is_number(t) or is_temporal(t)


def once(c: Column, read: Callable[[Column], Column]) -> Column:
    """``read(c)`` with ``c`` computed a single time per row.

    Projections share repeated parts of an expression, filters do not; a long reading of a computed column
    would compute that column at each mention.
    """
    return F.transform(F.array(c), read)[0]


def trim_ws(c: Column) -> Column:
    """Strip every kind of white space from both ends (``trim`` alone strips spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column, t: DataType) -> Column:
    """True for a missing cell: NULL, NaN, or text of white space only. Never NULL itself."""
    if is_text(t):
        return c.isNull() | (trim_ws(c) == "")
    if is_fractional(t):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(c: Column, t: DataType) -> Column:
    """The cell, or NULL when it is blank."""
    return F.when(~is_blank(c, t), c) if is_text(t) or is_fractional(t) else c


def to_num(c: Column, t: DataType) -> Column:
    """The cell as a number, NULL when it is not one. Typed numbers keep their type."""
    if is_text(t):
        return F.when(c.rlike(NUMBER), c.try_cast("double"))
    if is_fractional(t):
        return F.when(~F.isnan(c), c)
    if is_number(t):
        return c
    if isinstance(t, BooleanType):
        return c.cast("int")
    return F.lit(None).cast("double")


def number_text(c: Column, t: DataType, keep_point: bool = False) -> Column:
    """A number as plain text: the shortest digits that give the number back, without an exponent.

    Whole doubles are written without a decimal part, as keys are, or with ``.0``, as cells are shown.
    """
    if not is_fractional(t):
        return c.cast("string")

    def plain(s: Column) -> Column:
        digits = F.rtrim(F.replace(F.ltrim(F.substring_index(s, "E", 1), F.lit("-")), F.lit("."), F.lit("")), F.lit("0"))
        exponent = F.substring_index(s, "E", -1).cast("int")

        def spell(number: Column) -> Column:
            digits, exponent = number["digits"], number["exponent"]
            large = F.concat(F.rpad(F.left(digits, exponent + 1), exponent + 1, "0"), F.lit("."), F.substring(digits, exponent + 2, F.length(digits)), F.lit(""))
            small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
            return F.when(exponent >= 0, large).otherwise(small)

        parts = F.struct(digits.alias("digits"), exponent.alias("exponent"))
        return F.concat(F.when(s.startswith("-"), "-").otherwise(""), once(parts, spell))

    def read(s: Column) -> Column:
        with_point = F.when(s.contains("E"), plain(s)).otherwise(s)
        whole = F.regexp_replace(with_point, r"\.0*$", "")
        return F.regexp_replace(with_point, r"\.$", ".0") if keep_point else whole

    return once(c.cast("string"), read)


def norm_key(c: Column, t: DataType) -> Column:
    """The cell as a matching key: trimmed, lower case, and 123 the same as '123'."""
    if is_text(t):
        return F.lower(trim_ws(c))
    if is_fractional(t):
        return F.lower(number_text(present(c, t), t))
    return F.lower(c.cast("string"))


def norm_dup(c: Column, t: DataType) -> Column:
    """The cell as a duplicate-detection key: text trimmed and lower case, other types as they are."""
    return F.lower(trim_ws(c)) if is_text(t) else present(c, t)


def norm_literal(value) -> str | None:
    """The matching key of a value given by the caller; agrees with :func:`norm_key`."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float) and math.isfinite(value):
        text = format(Decimal(repr(value)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    return str(value).strip().lower()


def parse_number(value) -> int | float | None:
    """A caller's value as an exact int or a float, or None when it is not a number."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float, Decimal)):
        number = value
    elif value is not None and re.match(NUMBER, str(value), re.ASCII):
        text = str(value).strip()
        number = int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)
    else:
        return None
    if isinstance(number, int):
        return number
    number = float(number)
    if not math.isfinite(number):
        return None
    return int(number) if number.is_integer() else number


def number_literal(number: int | float) -> Column:
    """A literal that stays comparable with typed columns, so filters reach the scan."""
    if isinstance(number, int) and -(2**63) <= number < 2**63:
        return F.lit(number).cast("bigint")
    return F.lit(float(number))



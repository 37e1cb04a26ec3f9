"""The narrowest type that holds a column and the values put into it.

Types stand in an order: tinyint, smallint, int, bigint, decimal of 38 digits; a decimal grows by digits before and after its point; float
and, above all of them, double. What no number type holds is text.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType

from tablewright.functions.values import NUMBER, is_integral, trim_ws

_WHOLE_TYPES = ((ByteType(), 7), (ShortType(), 15), (IntegerType(), 31), (LongType(), 63))
MOST_DIGITS = 38
_LARGEST_FLOAT = 3.4028234663852886e38


@dataclass(frozen=True)
class Needs:
    """What numbers need: digits before and after the point, and their bounds. ``rough`` are numbers that only a double holds."""

    before: int
    after: int
    least: Decimal
    largest: Decimal
    rough: bool = False

    @classmethod
    def of(cls, number: int | float | str | Decimal) -> Needs:
        exact = Decimal(str(number)).normalize()
        sign, digits, exponent = exact.as_tuple()
        rough = abs(exact.adjusted()) > MOST_DIGITS
        return cls(max(len(digits) + exponent, 0), max(-exponent, 0), exact, exact, rough)


def holding(t: DataType, needs: Needs) -> DataType:
    """The narrowest number type that holds a column of type t and numbers with these needs; t itself if it does."""
    if isinstance(t, FloatType):
        return t if max(abs(needs.least), abs(needs.largest)) <= _LARGEST_FLOAT else DoubleType()
    if isinstance(t, DoubleType) or needs.rough:
        return DoubleType()
    if is_integral(t):
        if needs.after:
            return DoubleType()
        at = [type(w) for w, _ in _WHOLE_TYPES].index(type(t))
        for whole, bits in _WHOLE_TYPES[at:]:
            if -(2**bits) <= needs.least and needs.largest < 2**bits:
                return whole
        return DecimalType(MOST_DIGITS, 0) if needs.before <= MOST_DIGITS else DoubleType()
    before, after = max(t.precision - t.scale, needs.before), max(t.scale, needs.after)
    return DecimalType(before + after, after) if before + after <= MOST_DIGITS else DoubleType()


def needs_of(values: Column) -> Column:
    """What the numbers among texts need, as an aggregate; other texts count for nothing."""
    text = trim_ws(values)
    number = F.when(text.rlike(NUMBER), text)
    plain = F.when(~F.lower(number).contains("e"), F.ltrim(number, F.lit("+-")))
    parts = F.split(plain, "\\.")
    before = F.length(F.ltrim(parts[0], F.lit("0")))
    after = F.length(F.rtrim(F.coalesce(F.get(parts, 1), F.lit("")), F.lit("0")))
    # Numbers with an exponent are taken as doubles, whole ones of few digits by their value.
    double = F.when(F.lower(number).contains("e"), number.try_cast("double"))
    small = (double == F.floor(double)) & (F.abs(double) < 1e15)
    whole = F.coalesce(plain.try_cast("decimal(38,0)"), F.when(small, double).try_cast("decimal(38,0)"))
    whole = F.when(number.startswith("-") & plain.isNotNull(), -whole).otherwise(whole)
    return F.struct(
        F.coalesce(F.max(F.coalesce(before, F.lit(15))), F.lit(0)).alias("before"),
        F.coalesce(F.max(after), F.lit(0)).alias("after"),
        F.min(whole).alias("least"),
        F.max(whole).alias("largest"),
        F.max(F.abs(number.try_cast("double"))).alias("size"),
        F.coalesce(F.bool_or(double.isNotNull() & ~small), F.lit(False)).alias("rough"),
        F.count_if(values.isNotNull() & number.isNull()).alias("others"),
    )


def measured(row) -> Needs:
    """Needs from a row of `needs_of`."""
    size = Decimal(row["size"] or 0) if row["size"] != float("inf") else Decimal(10) ** 400
    least, largest = (-size, size) if row["least"] is None else (row["least"], row["largest"])
    # What has more digits than a decimal is not among the bounds.
    rough = row["rough"] or row["before"] > MOST_DIGITS
    return Needs(row["before"], row["after"], least, max(largest, size) if rough else largest, rough)


def read_into(values: Column, t: DataType) -> Column:
    """Texts as numbers of type t, exactly where t is exact; NULL where they are none."""
    text = trim_ws(values)
    number = F.when(text.rlike(NUMBER), text)
    if isinstance(t, (DoubleType, FloatType)):
        return number.try_cast("double").try_cast(t)
    exact = number.try_cast("decimal(38,0)") if is_integral(t) else number
    return exact.try_cast(t)

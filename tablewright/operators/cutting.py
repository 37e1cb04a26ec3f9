"""The first rows of a table of any size, found by where its order is cut.

The key of the last row to keep is narrowed down: a sample of the keys gives bounds, one grouped count tells how many rows lie between
them, and the search goes on between the two bounds that hold the row looked for. A few such rounds settle 10**12 rows. The result is
then a filter on the order's own columns: nothing is sorted or written, and the table keeps its order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from tablewright.columns import col, dtype
from tablewright.operators.asking import asked
from tablewright.operators.roworder import FILE, SEQ, order_columns

#: Keys that the driver looks at in a round, and bounds that a round counts between.
SAMPLE = 4096
BOUNDS = 64


class Order:
    """A table's order, or its reverse, as comparisons of rows with given keys. Missing keys come last, or first in reverse."""

    def __init__(self, df: DataFrame, reverse: bool):
        self.names = order_columns(df)
        self.reverse = reverse
        self.falls = [n.endswith("_desc") != reverse for n in self.names]
        # Moments are compared as numbers: their clock time may stand twice in a day.
        self.keys = [F.unix_micros(col(n)) if isinstance(dtype(df, n), TimestampType) else col(n) for n in self.names]
        self.kinds = ["bigint" if isinstance(dtype(df, n), TimestampType) else dtype(df, n).simpleString() for n in self.names]

    def columns(self) -> list[Column]:
        return [k.alias(f"k{i}") for i, k in enumerate(self.keys)]

    def terms(self) -> list[Column]:
        """Sort expressions over `columns`."""
        named = [F.col(f"k{i}") for i in range(len(self.keys))]
        ends = ("desc_nulls_first", "asc_nulls_first") if self.reverse else ("desc_nulls_last", "asc_nulls_last")
        return [getattr(k, ends[0] if falls else ends[1])() for k, falls in zip(named, self.falls, strict=True)]

    def _literal(self, i: int, value) -> Column:
        return F.lit(value).cast(self.kinds[i])

    def _ahead(self, i: int, value) -> Column:
        """The row's key i comes before the value."""
        key = self.keys[i]
        if value is None:
            return F.lit(False) if self.reverse else key.isNotNull()
        found = key > self._literal(i, value) if self.falls[i] else key < self._literal(i, value)
        return F.coalesce(found, F.lit(self.reverse))

    def same(self, bound: Sequence) -> Column:
        out = F.lit(True)
        for i, value in enumerate(bound):
            out = out & self.keys[i].eqNullSafe(self._literal(i, value))
        return out

    def before(self, bound: Sequence, or_same: bool = False) -> Column:
        out = F.lit(or_same)
        for i in reversed(range(len(bound))):
            out = self._ahead(i, bound[i]) | (self.keys[i].eqNullSafe(self._literal(i, bound[i])) & out)
        return out

    def upto(self, bound: Sequence) -> Column:
        return self.before(bound, or_same=True)


def _between(order: Order, bounds: Sequence[Row]) -> Column:
    """How many of the sorted bounds come before the row, by halving."""

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(order.upto(bounds[middle]), half(low, middle)).otherwise(half(middle + 1, high))

    return half(0, len(bounds))


def _evenly(keys: Sequence[Row], most: int) -> list[Row]:
    picked = [keys[(i + 1) * len(keys) // (most + 1)] for i in range(most)] if len(keys) > most else keys
    return list(dict.fromkeys(picked))


def _cut(df: DataFrame, order: Order, count: int, total: int, sample: int, bounds: int) -> tuple[Row, int, int]:
    """The key of row number `count`, how many rows of that key are kept and how many there are."""
    after: Row | None = None  # the row looked for comes after this key
    upto: Row | None = None  # and not after this one
    size, tries = total, 0
    while True:
        inside = df
        if after is not None:
            inside = inside.where(~order.upto(after))
        if upto is not None:
            inside = inside.where(order.upto(upto))
        if size <= sample:
            keys = inside.select(*order.columns()).orderBy(*order.terms()).collect()  # `sample` rows at most
            key = keys[count - 1]
            return key, sum(k == key for k in keys[:count]), sum(k == key for k in keys)
        tries += 1
        chosen = inside.select(*order.columns()).sample(fraction=min(1.0, sample / size), seed=tries)
        marks = _evenly(chosen.orderBy(*order.terms()).collect(), bounds)  # about `sample` rows
        if not marks:
            continue
        if marks == [upto]:
            alike = inside.where(order.same(upto)).count()
            if alike == size:
                return upto, count, size
            marks = [inside.where(~order.same(upto)).select(*order.columns()).first()]
        counted = dict(inside.groupBy(_between(order, marks).alias("place")).count().collect())
        for place in range(len(marks) + 1):
            here = counted.get(place, 0)
            if count <= here:
                break
            count -= here
        size = here
        after = marks[place - 1] if place else after
        upto = marks[place] if place < len(marks) else upto


def first_rows(df: DataFrame, count: int, reverse: bool = False, sample: int = SAMPLE, bounds: int = BOUNDS) -> DataFrame | None:
    """The first rows of an ordered table (the last, in reverse), as a filter of it.

    None if its row numbers differ from one run to the next, as those of tables made in memory may.
    """
    lasting = F.coalesce(F.bool_and(col(FILE).contains("\x01")), F.lit(True)) if SEQ in df.columns else F.lit(True)
    order = Order(df, reverse)

    def cut() -> tuple[bool, tuple | None]:
        total, lasts = df.agg(F.count(F.lit(1)), lasting).first()
        return lasts, _cut(df, order, count, total, sample, bounds) if lasts and count < total else None

    lasts, found = asked(cut)
    if not lasts:
        return None
    if found is None:
        return df
    key, kept, alike = found
    if kept == alike:
        return df.where(order.upto(key))
    return df.where(order.before(key)).unionByName(df.where(order.same(key)).limit(kept))

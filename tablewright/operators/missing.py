"""Missing cells: fill them, drop their rows, or report them."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tablewright.columns import col, dtype, exact_names, replace_columns, visible_columns
from tablewright.errors import OperationError
from tablewright.functions.dates import date_literal, parse_date
from tablewright.functions.fitting import Needs, holding
from tablewright.functions.values import (
    is_blank,
    is_fractional,
    is_number,
    is_temporal,
    is_text,
    number_text,
    parse_number,
    present,
)
from tablewright.operators.asking import asked
from tablewright.operators.profiling import chosen_columns
from tablewright.operators.roworder import BLOCK_BITS, FILE, POS, addressed, block, segment

# The names of the two neighbour fills.
PREVIOUS = ("previous", "ffill", "forward")
NEXT = ("next", "bfill", "backward")


def blank(df: DataFrame, name: str) -> Column:
    return is_blank(col(name), dtype(df, name))


def any_blank(df: DataFrame, names: Sequence[str]) -> Column:
    return reduce(operator.or_, [blank(df, n) for n in names])


@exact_names
def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop the rows in which any of ``columns`` (default: all) is blank."""
    return df.where(~any_blank(df, chosen_columns(df, columns) if columns else visible_columns(df)))


@exact_names
def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Blank cells per column, as rows ``column, blank_cells``; one pass."""
    names = chosen_columns(df, columns)
    counts = [F.struct(F.lit(n).alias("column"), F.count_if(blank(df, n)).alias("blank_cells")) for n in names]
    return df.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


@exact_names
def flag_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add a boolean ``<column>__is_blank`` per column; the data stays as it is."""
    names = chosen_columns(df, columns)
    return replace_columns(df, {f"{n}__is_blank": blank(df, n) for n in names})


def _fixed_fill(df: DataFrame, name: str, value) -> tuple[Column, Column | None]:
    """The filled column, and where the fill value does not fit the column's type, its form in the narrowest type that both fit."""
    c, t = col(name), dtype(df, name)
    gap = blank(df, name)
    if is_text(t):
        return F.when(gap, F.lit(str(value))).otherwise(c), None
    if is_number(t):
        if parse_number(value) is not None:
            exact = Decimal(str(value).strip()) if not isinstance(value, bool) else Decimal(int(value))
            fit = holding(t, Needs.of(exact))
            literal = F.lit(float(exact)) if is_fractional(fit) else F.lit(exact)
            if fit == t:
                return F.when(gap, literal.cast(t)).otherwise(c), None
            return c, F.when(gap, literal.cast(fit)).otherwise(c.cast(fit))
    elif is_temporal(t):
        moment = parse_date(value)
        if moment is not None:
            return F.when(gap, date_literal(moment, t)).otherwise(c), None
    elif isinstance(t, BooleanType) and str(value).strip().lower() in ("true", "false"):
        return F.when(gap, F.lit(str(value).strip().lower() == "true")).otherwise(c), None
    return c, F.when(gap, F.lit(str(value))).otherwise(number_text(c, t))


@exact_names
def fill_missing(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    fill_value=None,
    fill_method: str | None = None,
) -> DataFrame:
    """Fill blank cells of ``columns`` (default: all).

    With ``fill_method`` "previous" or "next" a blank takes the nearest value above or below it in the
    table's order; otherwise ``fill_value`` is put in. A number that does not fit a number column widens its type as far as needed
    (whole numbers become doubles for a fraction), any other value that does not fit turns the column into text; both only if there
    is a blank to fill.
    """
    method = (fill_method or "").strip().lower()
    names = chosen_columns(df, columns)
    if method in PREVIOUS or method in NEXT:
        return fill_from_neighbour(df, names, forward=method in PREVIOUS)
    if fill_value is None:
        raise OperationError("Say what to fill blanks with: a value, or 'previous' or 'next'.")
    filled: dict[str, Column] = {}
    as_text: dict[str, Column] = {}
    for name in names:
        filled[name], text = _fixed_fill(df, name, fill_value)
        if text is not None:
            as_text[name] = text
    if as_text:
        counts = [F.count_if(blank(df, n)).alias(f"g{i}") for i, n in enumerate(as_text)]
        gaps = asked(lambda: df.agg(*counts).first())
        filled.update({n: text for (n, text), gap in zip(as_text.items(), gaps) if gap})
    return replace_columns(df, filled)


def fill_from_neighbour(df: DataFrame, names: Sequence[str], forward: bool, bits: int = BLOCK_BITS) -> DataFrame:
    """Carry the nearest value that is not blank down (``forward``) or up the table.

    The ordered table is cut into blocks of consecutive rows. A window fills inside every block in
    parallel; the last (first) filled block before each block is found over the blocks of a file in parallel too,
    and only one address per file is carried in order. Blanks that reach a block's edge take the carried value
    by a join on the block, for which the window has already placed the rows.
    """
    base = addressed(df)
    file, seg = segment()
    cells = {n: present(col(n), dtype(base, n)) for n in names}
    slots = {n: f"__tw_c{i}" for i, n in enumerate(names)}
    nearest = F.max_by if forward else F.min_by
    # Upwards the rows are taken in reverse, as a frame that ends at the last row is computed anew for each row.
    before, upto = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)

    def along(*keys: str) -> list[Column]:
        return [F.asc(k) if forward else F.desc(k) for k in keys]

    edges = base.groupBy(file.alias(FILE), seg.alias("__tw_seg"), block(bits).alias("__tw_block")).agg(
        *[nearest(cells[n], F.when(cells[n].isNotNull(), col(POS))).alias(slots[n]) for n in names]
    )
    # Only the addresses of blocks are carried in order; their cells are fetched afterwards.
    seg_key = [FILE, "__tw_seg"]
    last_block = F.max if forward else F.min
    seg_edges = edges.groupBy(*seg_key).agg(
        *[last_block(F.when(F.col(s).isNotNull(), F.col("__tw_block"))).alias(s) for s in slots.values()]
    )

    def address(found: Column, number: Column) -> Column:
        return F.when(found.isNotNull(), F.struct(F.col(FILE).alias("file"), number.alias("block")))

    over_segs = Window.orderBy(*along(*seg_key)).rowsBetween(*before)
    seg_carry = seg_edges.select(
        *seg_key,
        *[F.last(address(F.col(s), F.col(s)), ignorenulls=True).over(over_segs).alias(f"{s}_seg") for s in slots.values()],
    )
    over_blocks = Window.partitionBy(*seg_key).orderBy(*along("__tw_block")).rowsBetween(*before)
    carry = (
        edges.select(
            *seg_key, "__tw_block",
            *[F.last(address(F.col(s), F.col("__tw_block")), ignorenulls=True).over(over_blocks).alias(f"{s}_block") for s in slots.values()],
        )
        .join(seg_carry, seg_key)
        .select(FILE, "__tw_block", *[F.coalesce(f"{s}_block", f"{s}_seg").alias(f"{s}_at") for s in slots.values()])
    )
    for s in slots.values():
        cell = edges.where(F.col(s).isNotNull()).select(
            F.struct(F.col(FILE).alias("file"), F.col("__tw_block").alias("block")).alias(f"{s}_at"), F.col(s).alias(f"{s}_carry")
        )
        carry = carry.join(cell, f"{s}_at", "left").drop(f"{s}_at")
    in_block = Window.partitionBy(FILE, "__tw_block").orderBy(*along(POS)).rowsBetween(*upto)
    placed = base.withColumn("__tw_block", block(bits))
    filled = placed.select("*", *[F.last(cells[n], ignorenulls=True).over(in_block).alias(slots[n]) for n in names])
    joined = filled.join(carry, [FILE, "__tw_block"], "left")
    return joined.select(
        *[
            F.coalesce(F.col(slots[c]), F.col(f"{slots[c]}_carry")).alias(c) if c in slots else col(c)
            for c in [*visible_columns(base), FILE, POS]
        ]
    )

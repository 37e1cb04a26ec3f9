"""Cell edits as a join: by key columns, or by row position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, StringType

from tablewright.columns import col, dtype, exact_names, replace_columns, require_columns
from tablewright.errors import OperationError
from tablewright.functions.dates import to_ts
from tablewright.functions.fitting import holding, measured, needs_of, read_into
from tablewright.functions.values import is_number, is_temporal, number_text, to_num, trim_ws
from tablewright.operators.asking import asked
from tablewright.operators.profiling import number_like, require_scalar
from tablewright.operators.roworder import BLOCK_BITS, FILE, POS, addressed, block, block_starts

# Edits known to be at most this many rows are sent to every executor, and the table is not shuffled.
BROADCAST_EDITS = 100_000

_TEXT = StringType()


def _given(value: Column) -> Column:
    """The edit's value, NULL when it clears the cell."""
    return F.nullif(trim_ws(value), F.lit(""))


def _read_as(value: Column, t: DataType) -> Column:
    """The edit's value in the column's own kind; NULL when it can't be read so."""
    if is_temporal(t):
        return to_ts(value, _TEXT).cast(t)
    if is_number(t):
        return read_into(value, t)
    if isinstance(t, BooleanType):
        return F.when(F.lower(value).isin("true", "false"), F.lower(value) == "true")
    return value


def _targets(edits: DataFrame, df: DataFrame, names: Sequence[str]) -> dict[str, DataType]:
    """The type each edited column ends up with: its own, the narrowest number type that holds its numbers and the new ones, or text
    for values that don't fit. One pass over the edits."""
    checks = []
    for i, name in enumerate(names):
        t = dtype(df, name)
        value = F.when(F.col("column") == name, _given(F.col("value")))
        if is_number(t):
            checks.append(needs_of(value).alias(f"c{i}"))
        else:
            checks.append(F.struct(F.count_if(value.isNotNull() & _read_as(value, t).isNull()).alias("others")).alias(f"c{i}"))
    found = asked(lambda: edits.agg(*checks).first())
    targets = {}
    for i, name in enumerate(names):
        t, row = dtype(df, name), found[f"c{i}"]
        targets[name] = _TEXT if row["others"] else holding(t, measured(row)) if is_number(t) else t
    return targets


@exact_names
def apply_edits(df: DataFrame, edits: DataFrame, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """Patch cells of ``df``.

    ``edits`` holds the key columns, ``column``, ``value`` (text; blank clears the cell) and ``seq``: of
    several edits of one cell the highest ``seq`` wins. Keys that match no row change nothing. ``bounded``
    says that the edits are known to be few, so that they are broadcast.
    """
    # One name more than there are columns is enough to meet an unknown one, which is an error.
    names = asked(lambda: [r[0] for r in edits.select("column").distinct().limit(len(df.columns) + 1).collect()])
    if not names:
        return df
    require_columns(df, names)
    require_scalar(df, names)
    targets = _targets(edits, df, names)
    numeric = number_like(df, [n for n in names if dtype(df, n) == _TEXT])
    slots = {n: f"__tw_e{i}" for i, n in enumerate(names)}
    latest = edits.groupBy(*[col(k) for k in keys]).agg(
        *[F.max_by(F.struct(_given(F.col("value")).alias("v")), F.when(F.col("column") == n, F.col("seq"))).alias(s)
          for n, s in slots.items()]
    )
    patched = df.join(F.broadcast(latest) if bounded else latest, list(keys), "left")
    new = {}
    for name, slot in slots.items():
        t, value = dtype(df, name), F.col(slot)["v"]
        if targets[name] == _TEXT and t != _TEXT:
            old, cell = number_text(col(name), t), value
        elif t == _TEXT:
            number = to_num(value, _TEXT)
            plain = F.coalesce(number_text(number, DoubleType()), value)
            old, cell = col(name), plain if numeric[name] else value
        else:
            old, cell = col(name).cast(targets[name]), _read_as(value, targets[name])
        new[name] = F.when(F.col(slot).isNotNull(), cell).otherwise(old)
    return replace_columns(patched, new).select(*[col(c) for c in df.columns])


def usable_edits(df: DataFrame, edits) -> list[tuple[int, str, str | None, int]]:
    """The edits that can hit a cell, as ``(row, column, value, seq)``; an unknown column is an error."""
    if not isinstance(edits, Sequence) or isinstance(edits, str) or not edits:
        raise OperationError("There are no cell edits.")
    entries = [e for e in edits if isinstance(e, Mapping) and e.get("column")]
    require_columns(df, [e["column"] for e in entries])
    usable = []
    for seq, entry in enumerate(entries):
        row = entry.get("row")
        if isinstance(row, int) and not isinstance(row, bool) and row >= 0:
            value = entry.get("value")
            usable.append((row, entry["column"], None if value is None else str(value), seq))
    return usable


def located_edits(base: DataFrame, usable: Sequence[tuple], bits: int = BLOCK_BITS) -> DataFrame:
    """Edits by row position turned into edits by row address.

    Row counts per block tell which block holds a position, so only the blocks that are edited are
    numbered. Positions and blocks meet on the stretch of ``2**bits`` positions they fall in, of which a
    block touches two at most.
    """
    wanted = base.sparkSession.createDataFrame(list(usable), "position bigint, column string, value string, seq bigint")
    few = len(usable) <= BROADCAST_EDITS
    small = F.broadcast if few else (lambda d: d)
    wanted = wanted.withColumn("stretch", F.shiftright("position", bits))
    end = F.col("start") + F.col("n")
    starts = block_starts(base, bits).withColumn(
        "stretch", F.explode(F.array_distinct(F.array(F.shiftright("start", bits), F.shiftright(end - 1, bits))))
    )
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < end)
    placed = starts.join(small(wanted), "stretch").where(inside)
    placed = placed.select(
        FILE, F.col("block").alias("__tw_block"), (F.col("position") - F.col("start")).alias("__tw_row"), "column", "value", "seq"
    )
    touched = placed.select(FILE, "__tw_block").distinct()
    rows = base.select(FILE, POS, block(bits).alias("__tw_block")).join(small(touched), [FILE, "__tw_block"], "left_semi")
    numbered = rows.withColumn("__tw_row", F.row_number().over(Window.partitionBy(FILE, "__tw_block").orderBy(POS)) - 1)
    return numbered.join(small(placed), [FILE, "__tw_block", "__tw_row"]).select(FILE, POS, "column", "value", "seq")


def patch(df: DataFrame, usable: Sequence[tuple], bits: int = BLOCK_BITS) -> tuple[DataFrame, int]:
    """Apply usable edits by row position; also tells how many of them hit a row.

    The edits came from the driver as a list, so the located ones fit there too. Fixing them as a small
    table leaves one join without a shuffle of the data.
    """
    if not usable:
        return df, 0
    base = addressed(df)
    hits = located_edits(base, usable, bits)
    found = asked(hits.collect)
    if not found:
        return df, 0
    fixed = df.sparkSession.createDataFrame(found, hits.schema)
    return apply_edits(base, fixed, [FILE, POS], bounded=len(found) <= BROADCAST_EDITS), len(found)


@exact_names
def set_cells(df: DataFrame, edits: Sequence[Mapping], bits: int = BLOCK_BITS) -> DataFrame:
    """Apply edits ``{row, column, value}``, ``row`` being the 0-based position in the table's order.

    Values take the column's kind, a blank value clears the cell, the last edit of a cell wins, and rows
    outside the table are skipped.
    """
    return patch(df, usable_edits(df, edits), bits)[0]

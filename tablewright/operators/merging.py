"""Combine tables: stack their rows with matching columns lined up, or place them side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tablewright.columns import col, dtype, exact_names, hidden_columns, visible_columns
from tablewright.errors import OperationError
from tablewright.functions.naming import norm_col, sheet_label
from tablewright.functions.values import is_number, is_scalar, is_temporal, number_text
from tablewright.operators.roworder import (
    BLOCK_BITS,
    FILE,
    POS,
    POSITION,
    SEQ,
    SORT,
    order_columns,
    with_positions,
    with_row_order,
)


def chosen_tables(tables: Mapping[str, DataFrame], names: Sequence[str] | None) -> list[str]:
    names = list(names or tables)
    unknown = [n for n in names if n not in tables]
    if unknown:
        raise OperationError(f"No such table: {', '.join(map(repr, unknown))}. There are: {', '.join(tables)}.")
    if len(names) < 2:
        raise OperationError("Combining needs at least two tables.")
    return names


def unified_names(
    columns: Mapping[str, Sequence[str]], column_groups: Sequence[Mapping] | None = None
) -> dict[str, dict[str, str]]:
    """Old to new column names per table.

    Columns listed as aliases of a group take its name. Of the others, those that differ only in case,
    spaces and punctuation take the spelling seen first.
    """
    groups = [((g.get("name") or "").strip(), g.get("aliases") or []) for g in column_groups or []]
    named = {alias: name for name, aliases in groups if name for alias in aliases}
    # One target for each normalised name: a group's name, else the spelling seen first. Names without a latin letter or digit have none.
    seen = [name for name, _ in groups if name] + [n for names in columns.values() for n in names]
    target = {norm_col(n): n for n in reversed(seen) if norm_col(n)}

    renames: dict[str, dict[str, str]] = {}
    for table, names in columns.items():
        new = [named.get(n) or target.get(norm_col(n), n) for n in names]
        clash = sorted({n for n in new if new.count(n) > 1})
        if clash:
            raise OperationError(f"Table '{table}' has several columns that mean {', '.join(map(repr, clash))}.")
        renames[table] = dict(zip(names, new))
    return renames


def _common_type(types: Sequence[DataType]) -> str | None:
    """The type stacked columns are cast to, or None when Spark's numeric widening or equality will do."""
    if all(t == types[0] for t in types) or all(is_number(t) for t in types):
        return None
    if all(is_temporal(t) for t in types):
        return "timestamp_ntz"
    if not all(is_scalar(t) for t in types):
        raise OperationError("Nested columns of different types can't be stacked.")
    return "string"


def _own_keys(df: DataFrame) -> list[str]:
    """The hidden columns that a table is sorted by, without its rows' places."""
    return [c for c in order_columns(df) if c not in (FILE, POS, SEQ)]


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of the first table, then the second, ...; a column absent from a table is NULL there.

    No shuffle and no write: the tables' rows stay where they are. Where a table was sorted, the result is ordered by the number of the
    table and then by that table's own keys, which are NULL in the rows of others. Columns whose types conflict become text.
    """
    frames = [with_row_order(f) for f in frames]
    place = POS if all(POS in f.columns or FILE not in f.columns for f in frames) else SEQ
    names = list(dict.fromkeys(c for f in frames for c in visible_columns(f)))
    targets = {n: _common_type([dtype(f, n) for f in frames if n in f.columns]) for n in names}
    # New names of all tables' keys, after the number of the table.
    keys: list[dict[str, str]] = []
    taken = 1
    for f in frames:
        keys.append({c: f"{SORT}{taken + i:02d}_{c.rsplit('_', 1)[1]}" for i, c in enumerate(_own_keys(f))})
        taken += len(keys[-1])

    def fitted(df: DataFrame, name: str) -> Column:
        t = dtype(df, name)
        if targets[name] is None or t.typeName() == targets[name]:
            return col(name)
        return (number_text(col(name), t) if targets[name] == "string" else col(name).cast(targets[name])).alias(name)

    def hidden(df: DataFrame, index: int) -> list[Column]:
        file = col(FILE) if FILE in df.columns else F.lit("")
        number = next((col(c) for c in (POS, SEQ) if c in df.columns), F.lit(0).cast("bigint"))
        out = [F.concat(F.lit(f"{index:06d}\x02"), file).alias(FILE), number.alias(place)]
        if taken > 1:
            out += [F.lit(index).alias(f"{SORT}00_asc"), *[col(c).alias(new) for c, new in keys[index].items()]]
        return out

    aligned = [f.select(*[fitted(f, n) for n in names if n in f.columns], *hidden(f, i)) for i, f in enumerate(frames)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)
    return whole.select(*[col(n) for n in names], *sorted(c for c in whole.columns if c.startswith(SORT)), FILE, place)


def side_by_side(frames: Sequence[DataFrame], bits: int = BLOCK_BITS) -> DataFrame:
    """First row next to first row, and so on; shorter tables are padded with NULL."""
    placed = []
    for frame in frames:
        numbered = with_positions(frame, bits)
        placed.append(numbered.select(POSITION, *[col(c) for c in visible_columns(numbered)]))
    joined = reduce(lambda a, b: a.join(b, POSITION, "full"), placed)
    return joined.withColumn(FILE, F.lit("")).withColumnRenamed(POSITION, POS)


@exact_names
def merge(
    tables: Mapping[str, DataFrame],
    merge_tables: Sequence[str] | None = None,
    column_groups: Sequence[Mapping] | None = None,
) -> DataFrame:
    """Merge tables (default: all) into one.

    Columns that mean the same are unified first. Tables that then share a column are stacked; tables that
    share none are placed side by side.
    """
    names = chosen_tables(tables, merge_tables)
    renames = unified_names({n: visible_columns(tables[n]) for n in names}, column_groups)
    frames = []
    for name in names:
        df = tables[name]
        new = renames[name]
        frames.append(df.select(*[col(c).alias(new[c]) for c in new], *[col(c) for c in hidden_columns(df)]))
    shared = sum(len(new) for new in renames.values()) > len({c for new in renames.values() for c in new.values()})
    return stack(frames) if shared else side_by_side(frames)


def combine_sheets(tables: Mapping[str, DataFrame], sheet_tables: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Several tables kept apart in one result, under labels that are safe and unique."""
    sheets: dict[str, DataFrame] = {}
    for name in chosen_tables(tables, sheet_tables):
        sheets[sheet_label(name, sheets)] = tables[name]
    return sheets

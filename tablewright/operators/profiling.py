"""What the cells of text columns mean, asked as operations need to know it.

Typed columns need no look at the data. A caller who knows a text column's meaning can say so with
``types={"Revenue": "number"}``; that saves the look and is how plans run on streams. Kinds are boolean,
integer, number, date and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType

from tablewright.columns import col, dtype, exact_names, require_columns, visible, visible_columns
from tablewright.errors import OperationError
from tablewright.functions.dates import to_ts
from tablewright.functions.values import is_blank, is_integral, is_number, is_scalar, is_temporal, is_text, to_num
from tablewright.operators.asking import asked
from tablewright.operators.roworder import POS, ordered, with_row_order

SAMPLE_ROWS = 5
LARGE_TABLE = 50_000
PROBE_ROWS = 500
NUMERIC_KINDS = ("integer", "number", "boolean")


def declared_kind(t: DataType) -> str:
    if isinstance(t, BooleanType):
        return "boolean"
    if is_integral(t):
        return "integer"
    if is_number(t):
        return "number"
    if is_temporal(t):
        return "date"
    return "text"


def require_scalar(df: DataFrame, names: Iterable[str]) -> None:
    nested = [n for n in names if not is_scalar(dtype(df, n))]
    if nested:
        raise OperationError(f"Nested columns can't be used here: {', '.join(nested)}.")


Types = Mapping[str, str] | None


Question = tuple[str, str]  # a text column, and what some cell of it may be

#: What some cell may be; the questions about dates are dear and asked together only.
PLAIN_QUESTIONS = ("filled", "number", "word", "no number")
DATE_QUESTIONS = ("date", "no date")


def _test(df: DataFrame, question: Question) -> Column:
    """Whether a cell is what is asked for: not NULL, a number, neither blank nor a number, ..."""
    name, what = question
    cell, t = col(name), dtype(df, name)
    if what == "filled":
        return cell.isNotNull()
    if what == "word":
        return ~is_blank(cell, t) & to_num(cell, t).isNull()
    read = to_ts(cell, t) if what.endswith("date") else to_num(cell, t)
    return cell.isNotNull() & read.isNull() if what.startswith("no ") else read.isNotNull()


def known_answers(df: DataFrame) -> dict[Question, bool]:
    """What is known of a table's text columns: whether some cell of a column is a number, and so on. Kept with the table, so that a
    column is looked at once however many steps ask about it."""
    if not hasattr(df, "tw_answers"):
        df.tw_answers = {}
    return df.tw_answers


def carry_answers(old: DataFrame, new: DataFrame, columns: Mapping[str, str], same_rows: bool) -> None:
    """Keep for `new` what is known of the columns (old to new name) that it took over from `old`. Of fewer rows only what no cell
    was remains known."""
    for (name, what), found in known_answers(old).items():
        if name in columns and columns[name] in new.columns and (same_rows or not found):
            known_answers(new)[columns[name], what] = found


def _known_kinds(df: DataFrame, names: Iterable[str], types: Types) -> tuple[dict[str, str], list[str]]:
    """Kinds that typed columns have or the caller declared, and the text columns that must be looked at."""
    known, unknown = {}, []
    for name in dict.fromkeys(names):
        t = dtype(df, name)
        if not is_text(t):
            known[name] = declared_kind(t)
        elif name in (types or {}):
            known[name] = types[name]
        else:
            unknown.append(name)
    if unknown and df.isStreaming:
        raise OperationError(f"Say what these text columns of the stream hold (types=...): {', '.join(unknown)}.")
    return known, unknown


def _seen(df: DataFrame, questions: Iterable[Question]) -> set[Question]:
    """The questions to which some cell is an answer.

    The first rows often settle the matter, and reading them touches only the first files. What they leave open is answered by one
    pass over the table, which answers what else may be asked of these columns as well.
    """
    wanted = list(dict.fromkeys(questions))
    known = known_answers(df)
    new = [q for q in wanted if q not in known]

    def in_head() -> tuple[set[Question], bool]:
        tests = [F.coalesce(_test(df, q), F.lit(False)).alias(f"t{i}") for i, q in enumerate(new)]
        head = df.select(*tests).limit(PROBE_ROWS).collect()
        return {q for i, q in enumerate(new) if any(r[i] for r in head)}, len(head) < PROBE_ROWS

    def in_all(questions: list[Question]) -> set[Question]:
        found = df.agg(*[F.bool_or(_test(df, q)).alias(f"t{i}") for i, q in enumerate(questions)]).first()
        return {q for q, seen in zip(questions, found, strict=True) if seen}

    if new:
        seen, whole = asked(in_head)
        known.update(dict.fromkeys(seen, True))
        left = [q for q in new if q not in seen]
        if left and not whole:
            names = {n for n, _ in left}
            kinds = PLAIN_QUESTIONS + (DATE_QUESTIONS if any(what in DATE_QUESTIONS for _, what in left) else ())
            left = [(n, what) for n in df.columns if n in names for what in kinds if not known.get((n, what))]
            seen = asked(lambda: in_all(left))
            known.update(dict.fromkeys(seen, True))
        known.update({q: False for q in left if q not in seen})
    return {q for q in wanted if known[q]}


@exact_names
def have_numbers(df: DataFrame, names: Iterable[str], types: Types = None) -> dict[str, bool]:
    """Whether any cell of a column is a number."""
    known, unknown = _known_kinds(df, names, types)
    seen = _seen(df, [(n, "number") for n in unknown])
    return {**{n: kind in NUMERIC_KINDS for n, kind in known.items()}, **{n: (n, "number") in seen for n in unknown}}


@exact_names
def have_dates(df: DataFrame, names: Iterable[str], types: Types = None) -> dict[str, bool]:
    """Whether any cell of a column is a date."""
    known, unknown = _known_kinds(df, names, types)
    seen = _seen(df, [(n, "date") for n in unknown])
    return {**{n: kind == "date" for n, kind in known.items()}, **{n: (n, "date") in seen for n in unknown}}


@exact_names
def number_like(df: DataFrame, names: Iterable[str], types: Types = None) -> dict[str, bool]:
    """Whether a column can be computed with: every cell that is not blank is a number."""
    known, unknown = _known_kinds(df, names, types)
    words = _seen(df, [(n, "word") for n in unknown])
    return {**{n: kind in NUMERIC_KINDS for n, kind in known.items()}, **{n: (n, "word") not in words for n in unknown}}


@exact_names
def sort_meaning(df: DataFrame, names: Iterable[str], types: Types = None) -> dict[str, str]:
    """What a column is ordered as: numbers or dates if every cell that is not NULL is one, else text."""
    known, unknown = _known_kinds(df, names, types)
    seen = _seen(df, [(n, what) for n in unknown for what in ("filled", "no number")])
    # Dates are looked for only where numbers are ruled out.
    seen |= _seen(df, [(n, "no date") for n in unknown if (n, "no number") in seen])

    def meaning(n: str) -> str:
        if (n, "filled") not in seen:
            return "text"
        if (n, "no number") not in seen:
            return "number"
        return "text" if (n, "no date") in seen else "date"

    return {**known, **{n: meaning(n) for n in unknown}}


@exact_names
def profile(df: DataFrame) -> DataFrame:
    """One row per column: ``position, column, type, rows, non_null, blank_cells``, in one pass.

    ``type`` is boolean, integer, number, date or text; a text column whose every value is a number or a
    date counts as such.
    """
    df = visible(df)
    entries = []
    for i, name in enumerate(df.columns):
        c, t = col(name), dtype(df, name)
        text = is_text(t)
        entries.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column"),
                F.lit(None if text else declared_kind(t)).cast("string").alias("declared"),
                F.count(F.lit(1)).alias("rows"),
                F.count(c).alias("non_null"),
                F.count_if(is_blank(c, t)).alias("blank_cells"),
                (F.count(to_num(c, t)) if text else F.lit(0).cast("bigint")).alias("numbers"),
                (F.count(to_ts(c, t)) if text else F.lit(0).cast("bigint")).alias("dates"),
            )
        )
    sniffed = (
        F.when(F.col("declared").isNotNull(), F.col("declared"))
        .when(F.col("non_null") == 0, "text")
        .when(F.col("numbers") == F.col("non_null"), "number")
        .when(F.col("dates") == F.col("non_null"), "date")
        .otherwise("text")
    )
    return (
        df.agg(F.array(*entries).alias("entries"))
        .select(F.inline("entries"))
        .select("position", "column", sniffed.alias("type"), "rows", "non_null", "blank_cells")
    )


def _json_value(value):
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return str(value)


@dataclass(frozen=True)
class TableSummary:
    row_count: int
    columns: list[dict]
    sample: DataFrame
    note: str | None
    truncated: bool

    def sample_rows(self) -> list[dict]:
        """The sample as plain rows that JSON can hold: dates as text, NaN and infinities as None."""
        return [{k: _json_value(v) for k, v in r.asDict(recursive=True).items()} for r in self.sample.collect()]


def _summary(df: DataFrame, sample_rows: int) -> TableSummary:
    found = profile(df).orderBy("position").collect()  # one row per column
    rows = found[0]["rows"] if found else 0
    note = None
    if rows == 0:
        note = "This table has no data rows."
    elif rows > LARGE_TABLE:
        note = f"Large table ({rows:,} rows); the sample shows the first {sample_rows}."
    return TableSummary(
        rows, [{"name": r["column"], "type": r["type"]} for r in found], preview(df, sample_rows), note, rows > sample_rows
    )


@exact_names
def inspect(df: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TableSummary:
    """Row count, column meanings and the first rows of a table, with a note for empty and large ones."""
    return _summary(df, sample_rows)


@exact_names
def inspect_tables(tables: Mapping[str, DataFrame], sample_rows: int = SAMPLE_ROWS) -> dict[str, TableSummary]:
    return {name: _summary(df, sample_rows) for name, df in tables.items()}


@dataclass(frozen=True)
class StoredAs:
    """Noted on a table as it was read, so that a preview can turn to the first files alone."""

    format: str
    path: str


def _first_files(df: DataFrame, n: int) -> DataFrame:
    """The leading files of an unchanged stored table that hold ``n`` rows, or the table itself."""
    stored, files = getattr(df, "stored_as", None), []
    if stored and POS in df.columns:
        files = sorted(map(unquote, df.inputFiles()))
    taken = 1
    while taken < len(files):
        reader = df.sparkSession.read.format(stored.format).schema(visible(df).schema).option("basePath", stored.path)
        head = reader.load(files[:taken])
        if len(head.select(F.lit(1)).limit(n).collect()) == n:
            return with_row_order(head, root=stored.path)
        taken *= 8
    return df


@exact_names
def preview(df: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` rows in the table's order. Of a table as it was read, only the first files are opened."""
    from tablewright.operators.sorting import limit

    return visible(ordered(limit(_first_files(df, n), n)))


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in visible_columns(df) if is_text(dtype(df, c))]


def chosen_columns(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    """The named columns, or all; nested ones are skipped unless named."""
    if columns:
        names = list(columns)
        require_columns(df, names)
        require_scalar(df, names)
        return names
    return [c for c in visible_columns(df) if is_scalar(dtype(df, c))]

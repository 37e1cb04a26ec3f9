"""Plans: a list of operations, each a flat mapping with an ``action``, run over named tables.

Every step is checked when it is reached - columns, literals, and what its rules need to know about the
data - and then only added to a lazy DataFrame. No expression built here fails on data, so a step that
passed its checks holds, and a step that does not pass leaves the result of the steps before it intact.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.columns import col, dtype, exact_names, visible_columns
from tablewright.errors import OperationError, StepFailed
from tablewright.functions.values import is_text
from tablewright.operators import aggregates, cleaning, edits, filters, formatting, formulas, lookups, merging, missing
from tablewright.operators.asking import Script, noted, repeated
from tablewright.operators.duplicates import remove_duplicates
from tablewright.operators.profiling import TableSummary, carry_answers, chosen_columns, inspect_tables, known_answers
from tablewright.operators.roworder import sort_keys
from tablewright.operators.selection import drop_columns, rename_columns, select_columns
from tablewright.operators.sorting import limit, sort
from tablewright.plans import report
from tablewright.plans.report import Fact, Observed, StepReport, plural
from tablewright.sources.writers import write_table


@dataclass
class Step:
    """What a step did: the new table and the sentence that says so, given the counts that the step watched."""

    df: DataFrame
    say: Callable[[Mapping[str, float]], str] = field(default=lambda counts: "")
    examples: DataFrame | None = None


@dataclass
class Context:
    """The tables a step may use, and the counts it wants.

    ``watch`` names counts of the rows that pass a place of the plan. With ``counting`` they are observed there, so that the job
    which makes the result counts them; without, they are only noted down, to be computed apart if ever.
    """

    tables: Mapping[str, DataFrame]
    types: Mapping[str, str]
    counting: bool = False
    facts: list[Fact] = field(default_factory=list)
    observed: list[Observed] = field(default_factory=list)

    def watch(self, frame: DataFrame, **measures: Column) -> DataFrame:
        """The frame to go on with."""
        if not self.counting:
            self.facts += [Fact(metric, frame, measure) for metric, measure in measures.items()]
            return frame
        self.observed.append(Observed(Observation(f"tw_{uuid.uuid4().hex}"), list(measures)))
        return frame.observe(self.observed[-1].observation, *[m.cast("double").alias(metric) for metric, m in measures.items()])

    def aside(self, frame: DataFrame, **measures: Column) -> None:
        """Counts of rows that do not pass through the plan."""
        self.facts += [] if self.counting else [Fact(metric, frame, measure) for metric, measure in measures.items()]


def _rows() -> Column:
    return F.count(F.lit(1))


# The plan vocabulary, that is the names of actions and of the fields that steps read, is fixed: plans written elsewhere use it.
Action = Callable[[DataFrame, Mapping, Context], Step]
_ACTIONS: dict[str, Action] = {}


def action(name: str):
    def register(function: Action) -> Action:
        _ACTIONS[name] = function
        return function

    return register


def _counted(metric: str, some: Callable[[float], str], none: str) -> Callable[[Mapping[str, float]], str]:
    """A sentence about a count, and another for a count of zero."""
    return lambda n: some(n[metric]) if n.get(metric) else none


def _total(columns: Sequence[Column]) -> Column:
    """Cells for which a condition holds, over several columns."""
    return reduce(lambda a, b: a + b, [F.count_if(c) for c in columns]) if columns else F.lit(0)


@action("sort")
def _sort(df, op, context) -> Step:
    columns, orders = op.get("columns") or [], op.get("orders") or []
    down = [i < len(orders) and orders[i] == "desc" for i in range(len(columns))]
    named = [f"{c} ({'descending' if d else 'ascending'})" for c, d in zip(columns, down)]
    return Step(sort(df, columns, orders, context.types), say=lambda n: f"Sorted by {', '.join(named)}.")


def _told(given) -> str:
    """A condition in words, as in: Ward equals 7."""
    c = filters.Condition.of(given)
    parts = [c.column, c.operator.replace("_", " ")]
    if c.operator == "between":
        parts.append(f"{c.value} and {c.value2}")
    elif c.operator not in filters.BLANK_TESTS:
        parts.append(", ".join(map(str, c.values)) if c.values else str(c.value))
    return " ".join(parts)


@action("filter")
def _filter(df, op, context) -> Step:
    kept = filters.filter_predicate(df, op.get("conditions"), op.get("combine"), context.types)
    df = context.watch(df, rows_before=_rows(), rows_after=F.count_if(kept))
    joiner = " or " if (op.get("combine") or "and").lower() == "or" else " and "
    told = joiner.join(map(_told, op["conditions"]))
    return Step(
        df.where(kept), lambda n: f"Kept {plural(n['rows_after'], 'row')} of {plural(n['rows_before'], 'row')} where {told}."
    )


@action("limit")
def _limit(df, op, context) -> Step:
    from_end = bool(op.get("from_end"))
    out = limit(context.watch(df, rows_before=_rows()), op.get("count"), from_end)
    where = "last" if from_end else "first"
    return Step(
        context.watch(out, rows_after=_rows()),
        lambda n: f"Kept the {where} {plural(n['rows_after'], 'row')} of {int(n['rows_before']):,}.",
    )


@action("remove_duplicates")
def _remove_duplicates(df, op, context) -> Step:
    out = remove_duplicates(context.watch(df, rows_before=_rows()), op.get("columns"))

    def say(n):
        removed = n["rows_before"] - n["rows_after"]
        if not removed:
            return "There were no duplicate rows."
        return f"Removed {plural(removed, 'duplicate row')}, keeping the first of each."

    return Step(context.watch(out, rows_after=_rows()), say)


@action("fill_missing")
def _fill_missing(df, op, context) -> Step:
    names = chosen_columns(df, op.get("columns"))
    df = context.watch(df, blank_before=_total([missing.blank(df, n) for n in names]))
    out = missing.fill_missing(df, op.get("columns"), op.get("fill_value"), op.get("fill_method"))
    out = context.watch(out, blank_after=_total([missing.blank(out, n) for n in names if n in out.columns]))

    def say(n):
        filled = n["blank_before"] - n["blank_after"]
        return f"Filled {plural(filled, 'blank cell')}." if filled else "There were no blank cells to fill."

    return Step(out, say)


@action("drop_missing")
def _drop_missing(df, op, context) -> Step:
    gone = missing.any_blank(df, chosen_columns(df, op.get("columns")))
    df = context.watch(df, rows_before=_rows(), rows_removed=F.count_if(gone))
    return Step(
        missing.drop_missing(df, op.get("columns")),
        _counted("rows_removed", lambda k: f"Removed {plural(k, 'row')} with blank cells.", "No row had blank cells."),
    )


@action("drop_invalid")
def _drop_invalid(df, op, context) -> Step:
    columns, kind = op.get("columns") or [], cleaning.invalid_kind(op.get("data_type"))
    cleaning.drop_invalid(df, columns, kind)  # checks the columns
    bad = reduce(lambda a, b: a | b, [cleaning.invalid(df, c, kind) for c in columns])
    out = cleaning.drop_invalid(context.watch(df, rows_before=_rows(), rows_removed=F.count_if(bad)), columns, kind)
    examples = reduce(lambda a, b: a.unionByName(b), [cleaning.offenders(df, c, kind) for c in columns]).limit(5)
    return Step(
        out,
        _counted("rows_removed", lambda k: f"Removed {plural(k, 'row')} without a valid {kind}.", f"Every {kind} was valid."),
        examples,
    )


@action("trim")
def _trim(df, op, context) -> Step:
    names = cleaning.trim_targets(df, op.get("columns"))
    df = context.watch(df, cells_changed=_total([cleaning.trimmed(col(n)) != col(n) for n in names]))
    return Step(
        cleaning.trim(df, op.get("columns")),
        _counted("cells_changed", lambda k: f"Trimmed {plural(k, 'cell')}.", "There was nothing to trim."),
    )


@action("find_replace")
def _find_replace(df, op, context) -> Step:
    find, put, column = op.get("find"), op.get("replace") or "", op.get("column")
    options = (bool(op.get("match_case")), bool(op.get("whole_cell")))
    names = cleaning.replace_targets(df, find, column)
    hits = [cleaning.replacement(col(n).cast("string"), find, put, *options)[1] for n in names]
    out = cleaning.find_replace(context.watch(df, cells_changed=_total(hits)), find, put, column, *options)
    return Step(
        out,
        _counted("cells_changed", lambda k: f"Replaced {find!r} by {put!r} in {plural(k, 'cell')}.", f"No cell matched {find!r}."),
    )


@action("add_formula_column")
def _add_formula_column(df, op, context) -> Step:
    name, formula = op.get("name"), op.get("formula") or ""
    out = formulas.add_formula_column(df, name, formula, bool(op.get("overwrite")), context.types)
    target = name.strip()
    if "/" in formula and not is_text(dtype(out, target)) and dtype(out, target).simpleString() == "double":
        out = context.watch(out, divisions_by_zero=F.count_if(F.abs(col(target)) == float("inf")))

    def say(n):
        text = f"Added column '{target}' = {formula}."
        zero = n.get("divisions_by_zero", 0)
        return text + (f" {plural(zero, 'row')} divided by zero." if zero else "")

    return Step(out, say)


@action("lookup")
def _lookup(df, op, context) -> Step:
    name, key = op.get("source_sheet"), op.get("key_column")
    source_key, wanted = op.get("source_key_column"), op.get("return_column")
    if not name:
        raise OperationError("A lookup needs the table to look in.")
    if name not in context.tables:
        raise OperationError(f"No such table: {name!r}. There are: {', '.join(context.tables)}.")
    source = context.tables[name]
    matched = lookups.match_first(df, source, key, source_key, wanted)
    matched = context.watch(matched, rows=_rows(), rows_matched=F.count("__tw_value"))
    out = lookups.shown(matched, op.get("new_column") or wanted)
    source_keys = source.select(col(source_key).alias("__tw_k"))
    per_source_key = source_keys.groupBy("__tw_k").agg(_rows().alias("__tw_n"))
    context.aside(per_source_key, source_rows=F.coalesce(F.sum("__tw_n"), F.lit(0)), source_keys=_rows())
    if dtype(df, key) == dtype(source, source_key):
        known = source_keys.where(F.col("__tw_k").isNotNull()).distinct()
        per_key = df.groupBy(col(key).alias("__tw_k")).agg(F.count(F.lit(1)).alias("__tw_n"))
        exact = per_key.join(known, "__tw_k", "left_semi")
        context.aside(exact, rows_matched_exactly=F.sum("__tw_n"))

    def say(n):
        text = f"Looked up '{wanted}' in '{name}' for {plural(n['rows'], 'row')}; {int(n['rows_matched']):,} matched."
        if n["source_rows"] > n["source_keys"]:
            text += " Keys repeat in the source, so the first match was taken."
        loose = n["rows_matched"] - n.get("rows_matched_exactly", 0)
        if loose > 0:
            text += f" {plural(loose, 'row')} matched only by ignoring case, spaces or number against text."
        return text

    return Step(out, say)


@action("aggregate")
def _aggregate(df, op, context) -> Step:
    func, column, value = op.get("agg_func"), op.get("agg_column"), op.get("count_value")
    group_by = op.get("group_by") or []
    spec = aggregates.check_aggregate(df, func, column, group_by, value)
    of = (f" of {value!r} in '{column}'" if value is not None else f" of '{column}'") if column else ""
    if group_by:
        out = aggregates.aggregate_by(df, func, column, group_by=group_by, count_value=value, types=context.types)
        by = ", ".join(group_by)
        return Step(context.watch(out, groups=_rows()), lambda n: f"The {spec.word}{of} by {by}: {plural(n['groups'], 'group')}.")
    aggregates.aggregate_table(df, func, column, count_value=value, types=context.types)  # checks the data's kind
    numeric = spec.func != "count"
    measures = {"value": aggregates.scalar_measure(df, spec), "cells_ignored": aggregates.ignored_measure(df, spec)}
    if numeric:
        measures["wrong_cells"] = F.count_if(cleaning.invalid(df, column, "number"))
    examples = cleaning.offenders(df, column) if numeric else None

    def say(n):
        text = f"The {spec.word}{of} is {aggregates.tidy(n['value'])}."
        kind = "blank or non-numeric" if numeric else "blank"
        return text + (f" It leaves out {plural(n['cells_ignored'], kind + ' cell')}." if n["cells_ignored"] else "")

    return Step(context.watch(df, **measures), say, examples)


@action("rename_columns")
def _rename_columns(df, op, context) -> Step:
    old, new = op.get("rename_from") or [], op.get("rename_to") or []
    pairs = ", ".join(f"'{a}' to '{b}'" for a, b in zip(old, new))
    return Step(rename_columns(df, old, new), say=lambda n: f"Renamed {pairs}.")


@action("drop_columns")
def _drop_columns(df, op, context) -> Step:
    columns = op.get("columns") or []
    return Step(drop_columns(df, columns), say=lambda n: f"Removed the columns {', '.join(columns)}.")


@action("select_columns")
def _select_columns(df, op, context) -> Step:
    columns = op.get("columns") or []
    return Step(select_columns(df, columns), say=lambda n: f"Kept the columns {', '.join(columns)}.")


@action("flag_missing")
def _flag_missing(df, op, context) -> Step:
    names = chosen_columns(df, op.get("columns"))
    return Step(
        context.watch(df, blank_cells=_total([missing.blank(df, n) for n in names])),
        _counted("blank_cells", lambda k: f"Found {plural(k, 'blank cell')}; the data is unchanged.", "There are no blank cells."),
    )


@action("format_cells")
def _format_cells(df, op, context) -> Step:
    columns, kind = op.get("format_columns") or [], op.get("number_format")
    options = {k: op.get(k) for k in ("decimals", "currency_symbol", "date_format")}
    out = formatting.format_cells(df, columns, kind, **options, bold_header=bool(op.get("bold_header")))
    unfit = formatting.format_mismatches(df, columns, kind, context.types) if columns else []
    text = f"Formatted {', '.join(columns)} as {kind}." if columns else "Headers carry no style here."
    if unfit:
        text += f" Nothing in {', '.join(unfit)} looks like {formatting.FORMATS[kind]}; the values are unchanged."
    return Step(out, say=lambda n: text)


@action("set_cells")
def _set_cells(df, op, context) -> Step:
    out, updated = edits.patch(df, edits.usable_edits(df, op.get("edits")))
    text = f"Updated {plural(updated, 'cell')}." if updated else "No cell was updated: the rows are outside the table."
    context.aside(df.sparkSession.range(1), cells_updated=F.max(F.lit(updated)))
    return Step(out, lambda n: text)


ACTIONS = (*_ACTIONS, "merge", "combine_sheets")


@dataclass
class PlanResult:
    """The working table, all tables, and reports that compute their counts when asked.

    ``workbook`` is set by ``combine_sheets``: several tables that make up the result together.
    """

    tables: dict[str, DataFrame]
    name: str
    reports: list[StepReport] = field(default_factory=list)
    workbook: dict[str, DataFrame] | None = None
    workbook_name: str | None = None
    started: DataFrame | None = None  # the primary table as it was given
    counted: PlanResult | None = None  # the same plan on tables that count the rows which pass
    _known: report.Counts | None = None

    @property
    def df(self) -> DataFrame:
        return self.tables[self.name]

    @property
    def result(self) -> DataFrame | dict[str, DataFrame]:
        return self.df if self.workbook is None else self.workbook

    @property
    def result_name(self) -> str:
        return self.name if self.workbook is None else self.workbook_name

    @property
    def actions(self) -> list[str]:
        return list(dict.fromkeys(r.action for r in self.reports))

    def row_counts(self) -> tuple[int, int]:
        """Rows of the primary table before the plan, and rows of the result."""
        results = self.workbook.values() if self.workbook is not None else [self.df]
        return self.started.count(), sum(df.count() for df in results)

    def preview(self, n: int = 8) -> dict[str, TableSummary]:
        """Row count, column meanings and first rows of the result, or of each of its tables."""
        return inspect_tables(self.workbook if self.workbook is not None else {self.name: self.df}, n)

    def _counts(self, recount: bool) -> report.Counts:
        """The counts that the job which makes the result has observed; that job is run here, once, if `write` hasn't run it."""
        if recount or self.counted is None:
            return {}
        if self._known is None:
            self._known = report.observed(self.counted.reports, [self.counted.df] if self.workbook is None else list(self.counted.workbook.values()))
        return self._known

    def report_frame(self, recount: bool = False) -> DataFrame:
        """The counts of all steps, most of them from one pass that makes the result. ``recount`` computes each apart from that pass:
        dearer, but not touched by tasks that Spark ran again after an executor was lost."""
        return report.report_frame(self.df.sparkSession, self.reports, self._counts(recount))

    def messages(self, recount: bool = False) -> list[str]:
        """One sentence per step, with its counts."""
        return report.messages(self.df.sparkSession, self.reports, self._counts(recount))

    def write(self, path: str, fmt: str | None = None) -> str:
        """Write the result, and take the counts of the steps in the same job where its rows need no sorting."""
        if self.workbook is not None:
            raise OperationError("The result is several tables; write them with write_tables.")
        if self.counted is None or sort_keys(self.df):
            return write_table(self.df, path, fmt)
        self._known = report.observed(self.counted.reports, [self.counted.df], lambda df: write_table(df, path, fmt))
        return path


def _merge_step(state: PlanResult, op: Mapping, context: Context) -> tuple[str, Step]:
    names = merging.chosen_tables(state.tables, op.get("merge_tables"))
    merged = merging.merge(state.tables, names, op.get("column_groups"))
    renames = merging.unified_names({n: visible_columns(state.tables[n]) for n in names}, op.get("column_groups"))
    pairs = sorted({(a, b) for new in renames.values() for a, b in new.items() if a != b})
    separate = sum(map(len, renames.values())) == len({b for new in renames.values() for b in new.values()})
    name = op.get("new_table") or "merged"

    def say(n):
        how = "Placed side by side" if separate else "Stacked"
        text = f"{how}: {', '.join(names)} into '{name}', {plural(n['rows_after'], 'row')}."
        return text + (f" Same meaning: {', '.join(f'{a} is {b}' for a, b in pairs)}." if pairs else "")

    return name, Step(context.watch(merged, rows_after=_rows()), say)


def _run_step(state: PlanResult, op: Mapping, context: Context) -> tuple[str, Step]:
    kind = op.get("action")
    if kind == "merge":
        return _merge_step(state, op, context)
    if kind == "combine_sheets":
        chosen = op.get("sheet_tables") or op.get("merge_tables")
        state.workbook = merging.combine_sheets(state.tables, chosen)
        state.workbook_name = op.get("new_table") or "combined"
        labels = ", ".join(state.workbook)
        return state.name, Step(state.df, say=lambda n: f"Combined {labels} into one result.")
    if kind not in _ACTIONS:
        raise OperationError(f"Unknown action: {kind!r}.")
    table = op.get("table") or state.name
    if table not in state.tables:
        raise OperationError(f"No such table: {table!r}. There are: {', '.join(state.tables)}.")
    return table, _ACTIONS[kind](state.tables[table], op, context)


#: Actions that keep all rows, and those that keep some; the others make new rows.
_SAME_ROWS = ("sort", "fill_missing", "trim", "find_replace", "add_formula_column", "lookup", "rename_columns", "drop_columns", "select_columns",
              "flag_missing", "format_cells", "set_cells")
_FEWER_ROWS = ("filter", "limit", "remove_duplicates", "drop_missing", "drop_invalid")


def _still_known(op: Mapping, before: DataFrame, after: DataFrame) -> None:
    """Keep what is known of the columns that a step left as they were, so that no later step looks at them again."""
    kind, grouped = op["action"], op.get("group_by")
    if kind not in (*_SAME_ROWS, *_FEWER_ROWS, "aggregate") or grouped:
        return
    names = {n: n for n in visible_columns(before)}
    every = [n for n in names if n in visible_columns(after)]
    changed = {
        "fill_missing": op.get("columns") or every,
        "trim": op.get("columns") or every,
        "find_replace": [op["column"]] if op.get("column") else every,
        "add_formula_column": [str(op.get("name") or "").strip()],
        "lookup": [op.get("new_column") or op.get("return_column")],
        "set_cells": [e.get("column") for e in op.get("edits") or [] if isinstance(e, Mapping)],
    }.get(kind, [])
    if kind == "rename_columns":
        names.update(zip(op.get("rename_from") or [], op.get("rename_to") or [], strict=True))
    carry_answers(before, after, {a: b for a, b in names.items() if a not in changed}, kind not in _FEWER_ROWS)
    conditions = [filters.Condition.of(c) for c in op.get("conditions") or []] if kind == "filter" else []
    if len(conditions) == 1 or (op.get("combine") or "and").lower() != "or":
        for c in conditions:
            # Rows that passed a comparison of numbers hold numbers, whatever stood there before.
            if c.operator in filters.RANGE_TESTS and known_answers(before).get((c.column, "number")) and filters.has_number_bounds(c):
                known_answers(after).update({(c.column, "word"): False, (c.column, "no number"): False})


@exact_names
def run_plan(
    tables: Mapping[str, DataFrame] | DataFrame,
    primary: str | None = None,
    operations: Sequence[Mapping] = (),
    types: Mapping[str, str] | None = None,
) -> PlanResult:
    """Run ``operations`` in order.

    Each acts on the table it names or else on the working table, which starts as ``primary`` and becomes
    the table a step produced. The given tables are not changed. An :class:`OperationError` in the first
    step is raised as it is; in a later one as :class:`StepFailed` with the result so far.
    """
    if isinstance(tables, DataFrame):
        primary = primary or "table"
        tables = {primary: tables}
    primary = primary or next(iter(tables))
    if primary not in tables:
        raise OperationError(f"No such table: {primary!r}. There are: {', '.join(tables)}.")
    state = PlanResult(dict(tables), primary, started=tables[primary])
    if not any(df.isStreaming for df in tables.values()):
        state.counted = PlanResult({n: df.select("*") for n, df in tables.items()}, primary)
    for number, op in enumerate(operations, start=1):
        context = Context(state.tables, types or {})
        known = {n: dict(known_answers(df)) for n, df in state.tables.items()}
        try:
            with noted() as script:
                table, step = _run_step(state, op, context)
        except (OperationError, PySparkException) as problem:
            # What Spark itself refuses is refused like any other step, and the good steps before it stay.
            if number == 1:
                if isinstance(problem, OperationError):
                    raise
                raise OperationError(f"Spark refuses this step: {problem.getCondition() or problem}") from problem
            raise StepFailed(state, number, str(problem)) from problem
        if table in state.tables and step.df is not state.tables[table]:
            _still_known(op, state.tables[table], step.df)
        if state.counted is not None:
            state.counted = _with_counts(state.counted, op, number, known, script, types or {})
        state.tables[table] = step.df
        state.name = table
        state.reports.append(StepReport(number, op["action"], table, context.facts, step.say, step.examples))
    return state


def _with_counts(state: PlanResult, op: Mapping, number: int, known: Mapping, script: Script, types: Mapping[str, str]) -> PlanResult | None:
    """The plan with a step added that observes its counts, from the answers that the step had when it was built without."""
    for name, df in state.tables.items():
        df.tw_answers = dict(known.get(name, {}))
    context = Context(state.tables, types, counting=True)
    with repeated(script):
        table, step = _run_step(state, op, context)
    state.tables[table], state.name = step.df, table
    state.reports.append(StepReport(number, op["action"], table, observed=context.observed))
    return state

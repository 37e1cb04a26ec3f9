"""Plans on streams.

Operations that look at one row at a time are the same expressions on a stream. What they need to know
about text columns must be declared, because a stream can't be profiled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tablewright.columns import visible_columns
from tablewright.errors import OperationError
from tablewright.plans.runner import run_plan

# The actions that act on each row alone (lookup: against a static table).
ROW_WISE = (
    "filter", "drop_missing", "drop_invalid", "trim", "find_replace", "add_formula_column", "lookup", "rename_columns",
    "drop_columns", "select_columns", "format_cells",
)


def run_on_stream(
    stream: DataFrame,
    operations: Sequence[Mapping],
    types: Mapping[str, str],
    static_tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Apply row-wise operations to a streaming table; write the result with ``writeStream``."""
    other = [op.get("action") for op in operations if op.get("action") not in ROW_WISE]
    if other:
        raise OperationError(f"These actions need the whole table and can't run on a stream: {', '.join(map(str, other))}.")
    tables = {**(static_tables or {}), "stream": stream}
    result = run_plan(tables, "stream", [{**op, "table": "stream"} for op in operations], types)
    return result.df.select(*[c for c in visible_columns(result.df)])

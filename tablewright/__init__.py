"""tablewright: forgiving table cleaning and analytics as lazy Spark plans.

Operators take and return DataFrames, so they chain with ``DataFrame.transform``; ``run_plan`` chains them
from a list of plain mappings and keeps honest counts of every step.
"""

from tablewright.columns import visible
from tablewright.errors import OperationError, StepFailed
from tablewright.operators.aggregates import (
    aggregate_answer,
    aggregate_by,
    aggregate_report,
    aggregate_table,
)
from tablewright.operators.cleaning import drop_invalid, find_replace, offenders, trim
from tablewright.operators.duplicates import remove_duplicates
from tablewright.operators.edits import apply_edits, set_cells
from tablewright.operators.filters import Condition, filter_rows
from tablewright.operators.formatting import format_cells, format_mismatches
from tablewright.operators.formulas import add_formula_column
from tablewright.operators.lookups import lookup
from tablewright.operators.merging import combine_sheets, merge
from tablewright.operators.missing import drop_missing, fill_missing, flag_missing, missing_report
from tablewright.operators.profiling import inspect, inspect_tables, preview, profile
from tablewright.operators.roworder import ordered, with_positions, with_row_order
from tablewright.operators.selection import drop_columns, rename_columns, select_columns
from tablewright.operators.sorting import limit, sort
from tablewright.plans.runner import ACTIONS, PlanResult, run_plan
from tablewright.session import build_session
from tablewright.sources.readers import TableSet, read_folder, read_table, read_tables
from tablewright.sources.writers import result_path, write_table, write_tables, written_tables
from tablewright.streaming.rowwise import run_on_stream

__all__ = [
    "ACTIONS", "Condition", "OperationError", "PlanResult", "StepFailed", "TableSet", "add_formula_column",
    "aggregate_answer", "aggregate_by", "aggregate_report", "aggregate_table", "apply_edits", "build_session",
    "combine_sheets", "drop_columns", "drop_invalid", "drop_missing", "fill_missing", "filter_rows", "find_replace",
    "flag_missing", "format_cells", "format_mismatches", "inspect", "inspect_tables", "limit", "lookup", "merge",
    "missing_report", "offenders", "ordered", "preview", "profile", "read_folder", "read_table",
    "read_tables", "remove_duplicates", "rename_columns", "result_path", "run_on_stream", "run_plan",
    "select_columns", "set_cells", "sort", "trim", "visible", "with_positions", "with_row_order", "write_table",
    "write_tables", "written_tables",
]

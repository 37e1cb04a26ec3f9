"""Column naming: exact-case lookup, quoting, and the hidden columns that carry row order."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tablewright.errors import OperationError

HIDDEN = "__tw_"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, also when it holds dots, spaces or back-ticks."""
    return F.col(quoted(name))


def dtype(df: DataFrame, name: str) -> DataType:
    return df.schema[name].dataType


def hidden_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(HIDDEN)]


def visible_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(HIDDEN)]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    known = visible_columns(df)
    unknown = [n for n in dict.fromkeys(names) if n not in known]
    if unknown:
        raise OperationError(
            f"No such column: {', '.join(repr(n) for n in unknown)}. The table has: {', '.join(known)}."
        )


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Set several columns at once, keeping the position of those that exist."""
    kept = [new[c].alias(c) if c in new else col(c) for c in df.columns]
    added = [expr.alias(c) for c, expr in new.items() if c not in df.columns]
    return df.select(*kept, *added)


def exact_names(operator):
    """Resolve column names by exact case while ``operator`` builds its plan.

    ``Amount`` and ``amount`` are two columns here. Names are bound to attributes when a DataFrame is
    built, so the session setting is put back as soon as the operator returns.
    """

    @functools.wraps(operator)
    def wrapped(*args, **kwargs):
        conf = SparkSession.active().conf
        before = conf.get("spark.sql.caseSensitive")
        if before == "true":
            return operator(*args, **kwargs)
        conf.set("spark.sql.caseSensitive", "true")
        try:
            return operator(*args, **kwargs)
        finally:
            conf.set("spark.sql.caseSensitive", before)

    return wrapped


@exact_names
def visible(df: DataFrame) -> DataFrame:
    """The table as a user sees it: without the row-order columns."""
    return df.select(*[col(c) for c in visible_columns(df)]) if hidden_columns(df) else df

"""The engine's queries over the shared test tables, each with the plain SQL that must give the same rows."""

from workload import aggregates, cleaning, combining, filters, formulas, ordering, plans, exactness, robustness  # noqa: F401
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Registry and inputs.

The test tables are clean, so messy versions of them are derived by expressions that mean the same in Spark
SQL and in the oracle's SQL. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright import read_table, visible, with_row_order

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * cast(month(o_orderdate) as int) - 2, 3)"
_Y, _M, _D = (
    f"lpad(cast({part}(o_orderdate) as string), {width}, '0')" for part, width in (("year", 4), ("month", 2), ("day", 2))
)

# Messy tables: name -> (base table, key, columns as SQL of both engines).
MESSY: dict[str, tuple[str, str, dict[str, str]]] = {
    "messy_customer": (
        "customer",
        "c_custkey",
        {
            "c_custkey": "c_custkey",
            "c_name": "c_name",
            "c_nationkey": "c_nationkey",
            "c_acctbal": "case when c_custkey % 9 = 0 then null else c_acctbal end",
            "segment": "case when c_custkey % 13 = 0 then null when c_custkey % 11 = 0 then '  ' "
            "when c_custkey % 3 = 0 then ' ' || lower(c_mktsegment) else c_mktsegment end",
            "points": "case when c_custkey % 17 = 0 then 'ABC' when c_custkey % 19 = 0 then '12A' "
            "when c_custkey % 23 = 0 then '' when c_custkey % 29 = 0 then null "
            "else cast((c_custkey * 37) % 1000 as string) end",
            "level": "case when c_custkey % 7 = 0 then null else cast((c_custkey * 11) % 400 as string) end",
            "code": "case when c_custkey % 5 = 0 then null when c_custkey % 2 = 0 then ' c' || cast(c_custkey as string) || ' ' "
            "else 'C' || cast(c_custkey as string) end",
        },
    ),
    "messy_orders": (
        "orders",
        "o_orderkey",
        {
            "o_orderkey": "o_orderkey",
            "o_totalprice": "o_totalprice",
            "placed": "case when o_orderkey % 29 = 0 then 'soon' when o_orderkey % 31 = 0 then null "
            f"when o_orderkey % 4 = 0 then {_Y} || '-' || {_M} || '-' || {_D} "
            f"when o_orderkey % 4 = 1 then {_M} || '/' || {_D} || '/' || {_Y} "
            f"when o_orderkey % 4 = 2 then {_Y} || '/' || {_M} || '/' || {_D} "
            f"else {_MONTH} || ' ' || {_D} || ' ' || {_Y} end",
            "code": "case when o_custkey % 2 = 0 then 'C' || cast(o_custkey as string) || '  ' else 'c' || cast(o_custkey as string) end",
        },
    ),
    "messy_events": (
        "events",
        "event_id",
        {
            "event_id": "event_id",
            "user_id": "user_id",
            "kind": "case when event_id % 5 in (0, 2, 3) then null when event_id % 7 = 0 then '  ' else event_type end",
            "amount": "case when event_id % 3 = 0 or event_id % 97 > 60 then null else value end",
        },
    ),
    "messy_documents": (
        "documents",
        "doc_id",
        {
            "doc_id": "doc_id",
            "lang": "case when doc_id % 6 = 0 then ' ' || upper(lang) || ' ' else lang end",
            "text": "case when doc_id % 2 = 0 then '  ' || replace(text, ' ', '   ') || ' ' else text end",
        },
    ),
}

# The oracle's reading of a date written in any of the shapes above.
PLACED = "try_strptime(placed, ['%Y-%m-%d', '%m/%d/%Y', '%Y/%m/%d', '%b %d %Y'])"
# The oracle's reading of a number.
POINTS = "try_cast(nullif(trim(points), '') as double)"


def source(spark: SparkSession, sf: str, name: str, order_by: str | None = None) -> DataFrame:
    """A test table or a messy version of one. ``order_by`` gives it a row order."""
    base, _, columns = MESSY.get(name, (name, None, None))
    df = read_table(spark, f"{sf}/{base}.parquet", order=False)
    if columns:
        df = df.selectExpr(*[f"{expr} as {column}" for column, expr in columns.items()])
    return with_row_order(df, [order_by]) if order_by else df


def _messy_sql(name: str) -> str:
    base, _, columns = MESSY[name]
    return f"{name} as (select {', '.join(f'{expr} as {column}' for column, expr in columns.items())} from {base})"


def oracle(sql: str) -> str:
    """The SQL with the messy tables it mentions defined in front."""
    used = [_messy_sql(name) for name in MESSY if name in sql]
    if not used:
        return sql
    joiner = ", " if sql.lstrip().lower().startswith("with ") else " "
    rest = sql.lstrip()[5:] if joiner == ", " else sql
    return f"with {', '.join(used)}{joiner}{rest}"


def register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf: visible(query(spark, sf))
    if sql is not None:
        ORACLES[name] = oracle(sql)


def query(sql: str | None):
    """Register the decorated function under its name, with the SQL of the same meaning."""

    def keep(function: Query) -> Query:
        register(function.__name__, function, sql)
        return function

    return keep

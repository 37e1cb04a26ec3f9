"""Scalar and grouped aggregates."""

from pyspark.sql import functions as F

from tablewright import aggregate_by, aggregate_report, aggregate_table
from workload.base import POINTS, query, register, source


def _rounded(df, column):
    """Totals of doubles depend on the order of addition in their last digits."""
    return df.withColumn(column, F.round(column, 4))


for _func, _sql in (("sum", "round(sum({c}), 4)"), ("average", "round(avg({c}), 4)"), ("min", "min({c})"), ("max", "max({c})")):
    _scalar, _label = f"{_func}_of_l_extendedprice", f"{_func}_of_l_quantity"

    def _whole(spark, sf, func=_func, label=_scalar):
        out = aggregate_table(source(spark, sf, "lineitem"), func, "l_extendedprice")
        return _rounded(out, label) if func in ("sum", "average") else out

    def _grouped(spark, sf, func=_func, label=_label):
        out = aggregate_by(source(spark, sf, "lineitem"), func, "l_quantity", group_by=["l_returnflag", "l_linestatus"])
        return _rounded(out, label) if func in ("sum", "average") else out

    register(f"aggregate_{_func}", _whole, f"select {_sql.format(c='l_extendedprice')} as {_scalar} from lineitem")
    register(
        f"group_{_func}",
        _grouped,
        f"select l_returnflag, l_linestatus, {_sql.format(c='l_quantity')} as {_label} from lineitem group by all",
    )


@query("select count(*) as count from lineitem")
def aggregate_count(spark, sf):
    return aggregate_table(source(spark, sf, "lineitem"), "count")


@query("select count(*) filter (trim(segment) <> '') as count_of_segment from messy_customer")
def aggregate_count_filled(spark, sf):
    return aggregate_table(source(spark, sf, "messy_customer"), "count", "segment")


@query("select count(*) filter (lower(trim(segment)) = 'furniture') as count_of_Furniture from messy_customer")
def aggregate_count_value(spark, sf):
    return aggregate_table(source(spark, sf, "messy_customer"), "count", "segment", count_value="Furniture")


@query(f"select sum({POINTS}) as value, count(*) - count({POINTS}) as ignored_cells from messy_customer")
def aggregate_numbers_in_text(spark, sf):
    return aggregate_report(source(spark, sf, "messy_customer"), "sum", "points")


@query("select max(o_orderdate) as max_of_o_orderdate from orders")
def aggregate_latest_date(spark, sf):
    return aggregate_table(source(spark, sf, "orders"), "max", "o_orderdate")


@query("select sum(o_custkey)::bigint as sum_of_o_custkey from orders")
def aggregate_sum_of_integers(spark, sf):
    return aggregate_table(source(spark, sf, "orders"), "sum", "o_custkey")


@query("select o_orderpriority, count(*) as count from orders group by all")
def group_count(spark, sf):
    return aggregate_by(source(spark, sf, "orders"), "count", group_by=["o_orderpriority"])


@query("""select o_orderpriority, count(*) as count_of_f from orders where lower(trim(o_orderstatus)) = 'f' group by all""")
def group_count_value(spark, sf):
    return aggregate_by(source(spark, sf, "orders"), "count", "o_orderstatus", group_by=["o_orderpriority"], count_value="f")


@query(f"select coalesce(segment, '(blank)') as segment, max({POINTS}) as max_of_points from messy_customer group by all")
def group_blank_label(spark, sf):
    return aggregate_by(source(spark, sf, "messy_customer"), "max", "points", group_by=["segment"])


@query("""select event_type, user_id, round(sum(value), 4) as sum_of_value from events group by all""")
def group_sum_of_events(spark, sf):
    return _rounded(aggregate_by(source(spark, sf, "events"), "sum", "value", group_by=["event_type", "user_id"]), "sum_of_value")

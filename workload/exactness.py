"""Queries over values at the edge of their types, sorted tables put together, and results of several tables."""

from pyspark.sql import functions as F

from tablewright import add_formula_column, apply_edits, fill_missing, filter_rows, limit, merge, sort, write_tables
from tablewright.operators.roworder import scratch_path
from tablewright.sources.writers import written_tables
from workload.base import query, source

_SPARK_CLOCK = (
    "date_format(o_orderdate, 'MM/dd/yyyy') || ' ' || cast(o_orderkey % 12 + 1 as string) || case when o_orderkey % 2 = 0 then ':05 PM' else ':45:30 a.m.' end "
    "|| case when o_orderkey % 3 = 0 then ' UTC' when o_orderkey % 3 = 1 then ' +05:30' else ' -0800' end"
)
_DUCK_CLOCK = _SPARK_CLOCK.replace("date_format(o_orderdate, 'MM/dd/yyyy')", "strftime(o_orderdate, '%m/%d/%Y')")
_CLOCK_MOMENT = (
    "o_orderdate + to_hours(cast((o_orderkey % 12 + 1) % 12 + case when o_orderkey % 2 = 0 then 12 else 0 end as bigint)) "
    "+ case when o_orderkey % 2 = 0 then interval '5 minutes' else interval '45 minutes 30 seconds' end "
    "- case when o_orderkey % 3 = 0 then interval '0 minutes' when o_orderkey % 3 = 1 then interval '330 minutes' else interval '-480 minutes' end"
)


@query(f"select o_orderkey, {_DUCK_CLOCK} as shown from orders where {_CLOCK_MOMENT} > timestamp '1996-03-10 20:30:00'")
def filter_half_days_with_zones(spark, sf):
    shown = source(spark, sf, "orders", "o_orderkey").selectExpr("o_orderkey", f"{_SPARK_CLOCK} as shown")
    return filter_rows(shown, [{"column": "shown", "operator": "greater_than", "value": "Mar 10 1996 10:00 pm +01:30"}])


_BIG = "o_orderkey * 1000 + 9007199254740993"


@query(f"""select o_orderkey, big, ((big % 7) + 0)::bigint as rest, big as floor, (round_even(big::decimal(38,0) / 100, 0) * 100)::bigint as hundreds
           from (select o_orderkey, ({_BIG})::bigint as big from orders)""")
def formula_whole_rounding(spark, sf):
    orders = source(spark, sf, "orders").selectExpr("o_orderkey", f"{_BIG} as big")
    out = add_formula_column(add_formula_column(orders, "rest", "{big} % 7"), "floor", "INT({big})")
    return add_formula_column(out, "hundreds", "ROUND({big}, -2)")


@query("""select l_orderkey, l_linenumber, big, (big::hugeint * l_linenumber + big)::varchar as result
          from (select l_orderkey, l_linenumber, (l_orderkey + 4611686018427387904)::bigint as big from lineitem)""")
def formula_beyond_64_bits(spark, sf):
    lines = source(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey + 4611686018427387904 as big")
    return add_formula_column(lines, "result", "{big} * {l_linenumber} + {big}").withColumn("result", F.col("result").cast("string"))


@query("""select c_custkey, coalesce(case when c_custkey % 9 <> 0 then c_nationkey end, 300)::smallint as nation,
          coalesce(case when c_custkey % 7 <> 0 then (c_custkey % 100)::decimal(5,2) end, 12345.678)::decimal(8,3)::varchar as share from customer""")
def fill_widens_columns(spark, sf):
    customers = source(spark, sf, "customer").selectExpr(
        "c_custkey", "cast(case when c_custkey % 9 <> 0 then c_nationkey end as tinyint) as nation",
        "case when c_custkey % 7 <> 0 then cast(c_custkey % 100 as decimal(5,2)) end as share",
    )
    return fill_missing(fill_missing(customers, ["nation"], "300"), ["share"], "12345.678").withColumn("share", F.col("share").cast("string"))


@query("""select s_suppkey, case when s_suppkey % 5 = 0 then 9007199254740993 + s_suppkey else s_nationkey end::bigint as nation from supplier""")
def edits_widen_columns(spark, sf):
    suppliers = source(spark, sf, "supplier").selectExpr("s_suppkey", "cast(s_nationkey as int) as nation")
    edits = source(spark, sf, "supplier").where("s_suppkey % 5 = 0").selectExpr(
        "s_suppkey", "'nation' as column", "cast(9007199254740993 + s_suppkey as string) as value", "s_suppkey as seq"
    )
    return apply_edits(suppliers, edits, ["s_suppkey"])


@query("""select name, balance from (select c_name as name, c_acctbal as balance, 0 as t, row_number() over (order by c_acctbal desc, c_custkey) as i from customer
          union all select s_name, s_acctbal, 1, row_number() over (order by s_name) from supplier) order by t, i limit (select count(*) + 7 from customer)""")
def stack_sorted_tables(spark, sf):
    customers = source(spark, sf, "customer", "c_custkey").selectExpr("c_name as name", "c_acctbal as balance", "*").drop("c_name", "c_acctbal")
    customers = sort(customers, ["balance"], ["desc"])
    suppliers = sort(source(spark, sf, "supplier", "s_suppkey").selectExpr("s_name as Name", "s_acctbal as Balance", "*").drop("s_name", "s_acctbal"), ["Name"])
    stacked = merge({"customers": customers, "suppliers": suppliers})
    return limit(stacked, customers.count() + 7).select("name", "balance")


@query("select * from lineitem order by l_extendedprice desc, l_orderkey desc, l_linenumber desc limit 5000")
def limit_many_from_the_end(spark, sf):
    return limit(sort(source(spark, sf, "lineitem", "l_orderkey").drop("__tw_sort_00_asc"), ["l_extendedprice", "l_orderkey", "l_linenumber"]), 5000, from_end=True)


@query("""select 'customer' as label, c_custkey as k, c_name as name from customer union all select 'supplier', s_suppkey, s_name from supplier
          union all select 'part', p_partkey, p_name from part""")
def tables_written_as_one(spark, sf):
    keys = {"customer": "c", "supplier": "s", "part": "p"}
    key_names = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
    tables = {name: source(spark, sf, name).selectExpr(f"{key_names[name]} as k", f"{short}_name as name") for name, short in keys.items()}
    base = f"{scratch_path(spark)}/result"
    write_tables(tables, base)
    parts = [df.select(F.lit(label).alias("label"), "k", "name") for label, df in written_tables(spark, base).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

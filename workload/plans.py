"""Plans over several steps and tables, files written and read back."""

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tablewright import OperationError, StepFailed, read_table, run_plan, write_table
from tablewright.functions.dates import to_ts
from tablewright.operators.roworder import scratch_path
from workload.base import PLACED, POINTS, query, source

REVENUE_STEPS = [
    {"action": "filter", "conditions": [{"column": "l_quantity", "operator": "between", "value": "40", "value2": "5"}]},
    {"action": "add_formula_column", "name": "Net", "formula": "{l_extendedprice} * (1 - {l_discount})"},
    {"action": "aggregate", "agg_func": "sum", "agg_column": "Net", "group_by": ["l_returnflag"]},
    {"action": "sort", "columns": ["sum_of_Net"], "orders": ["desc"]},
]


@query("""select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as "sum_of_Net" from lineitem
          where l_quantity between 5 and 40 group by l_returnflag""")
def plan_revenue(spark, sf):
    result = run_plan({"lineitem": source(spark, sf, "lineitem")}, "lineitem", REVENUE_STEPS)
    return result.df.withColumn("sum_of_Net", F.round("sum_of_Net", 2))


@query(f"""select c.n_name, round(sum(c.points), 2) as sum_of_points from
           (select coalesce(n_name, 'Not found') as n_name, {POINTS} as points from messy_customer m
            left join nation on m.c_nationkey = n_nationkey where trim(segment) <> '' and (trim(points) = '' or points is null or {POINTS} is not null)) c
           group by all having sum(c.points) is not null order by sum_of_points desc, n_name limit 10""")
def plan_lookup_then_group(spark, sf):
    tables = {"customer": source(spark, sf, "messy_customer", "c_custkey"), "nation": source(spark, sf, "nation", "n_nationkey")}
    steps = [
        {"action": "trim"},
        {"action": "filter", "conditions": [{"column": "segment", "operator": "not_blank"}]},
        {"action": "drop_invalid", "columns": ["points"]},
        {"action": "lookup", "key_column": "c_nationkey", "source_sheet": "nation", "source_key_column": "n_nationkey", "return_column": "n_name"},
        {"action": "aggregate", "agg_func": "sum", "agg_column": "points", "group_by": ["n_name"]},
        {"action": "sort", "columns": ["sum_of_points", "n_name"], "orders": ["desc", "asc"]},
        {"action": "limit", "count": 10},
    ]
    return run_plan(tables, "customer", steps).df.withColumn("sum_of_points", F.round("sum_of_points", 2))


@query("""select kind, round(sum(amount), 4) as sum_of_amount from
          (select 'c' as kind, c_acctbal as amount from customer union all select 's', s_acctbal from supplier) group by kind""")
def plan_merge_then_group(spark, sf):
    tables = {
        "customers": source(spark, sf, "customer").selectExpr("'c' as Kind", "c_acctbal as `Amount `"),
        "suppliers": source(spark, sf, "supplier").selectExpr("'s' as kind", "s_acctbal as AMOUNT"),
    }
    steps = [
        {"action": "merge", "new_table": "all"},
        {"action": "rename_columns", "rename_from": ["Kind", "Amount "], "rename_to": ["kind", "amount"]},
        {"action": "aggregate", "agg_func": "sum", "agg_column": "amount", "group_by": ["kind"]},
    ]
    return run_plan(tables, "customers", steps).df.withColumn("sum_of_amount", F.round("sum_of_amount", 4))


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 400000 order by o_totalprice desc, o_orderkey limit 20")
def plan_keeps_good_steps(spark, sf):
    steps = [
        {"action": "filter", "conditions": [{"column": "o_totalprice", "operator": "greater_than", "value": "400000"}]},
        {"action": "sort", "columns": ["o_totalprice"], "orders": ["desc"]},
        {"action": "limit", "count": 20},
        {"action": "select_columns", "columns": ["o_orderkey", "o_totalprice"]},
        {"action": "aggregate", "agg_func": "sum", "agg_column": "no such column"},
    ]
    try:
        run_plan({"orders": source(spark, sf, "orders", "o_orderkey")}, "orders", steps)
    except StepFailed as failed:
        return failed.result.df
    raise OperationError("The last step should have failed.")


@query(f"""with valid as (select * from messy_customer where points is null or trim(points) = '' or {POINTS} is not null),
  cleaned as (select * from valid where segment is not null and trim(segment) <> ''),
  firsts as (select * from cleaned qualify row_number() over (partition by lower(trim(segment)), c_nationkey order by c_custkey) = 1)
  select 1 as step, 'drop_invalid' as action, 'customer' as "table", 'rows_before' as metric, count(*)::double as value from messy_customer
  union all select 1, 'drop_invalid', 'customer', 'rows_removed', (select count(*) from messy_customer) - (select count(*) from valid)
  union all select 2, 'drop_missing', 'customer', 'rows_before', count(*) from valid
  union all select 2, 'drop_missing', 'customer', 'rows_removed', (select count(*) from valid) - (select count(*) from cleaned)
  union all select 3, 'trim', 'customer', 'cells_changed', count(*) filter (segment <> trim(segment)) from cleaned
  union all select 4, 'remove_duplicates', 'customer', 'rows_before', count(*) from cleaned
  union all select 4, 'remove_duplicates', 'customer', 'rows_after', count(*) from firsts
  union all select 5, 'aggregate', 'customer', 'value', sum({POINTS}) from firsts
  union all select 5, 'aggregate', 'customer', 'cells_ignored', count(*) - count({POINTS}) from firsts
  union all select 5, 'aggregate', 'customer', 'wrong_cells', 0""")
def plan_step_report(spark, sf):
    steps = [
        {"action": "drop_invalid", "columns": ["points"]},
        {"action": "drop_missing", "columns": ["segment"]},
        {"action": "trim", "columns": ["segment"]},
        {"action": "remove_duplicates", "columns": ["segment", "c_nationkey"]},
        {"action": "aggregate", "agg_func": "sum", "agg_column": "points"},
    ]
    return run_plan({"customer": source(spark, sf, "messy_customer", "c_custkey")}, "customer", steps).report_frame()


@query("""select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal,
          case when segment <> '' then segment end as segment, case when points <> '' then points end as points, level::bigint as level, code
          from messy_customer""")
def csv_written_and_read(spark, sf):
    path = f"{scratch_path(spark)}.csv"
    write_table(source(spark, sf, "messy_customer"), path)
    return read_table(spark, path)


@query(f"""select o_orderkey, o_totalprice, placed, code, coalesce(year({PLACED}) < 1998, false) as early from messy_orders""")
def parquet_written_and_read(spark, sf):
    path = f"{scratch_path(spark)}.parquet"
    early = [{"action": "add_formula_column", "name": "early", "formula": '{when} < "1998-01-01"'},
             {"action": "drop_columns", "columns": ["when"]}]
    dated = source(spark, sf, "messy_orders").withColumn("when", to_ts(F.col("placed"), StringType()))
    write_table(run_plan({"orders": dated}, "orders", early).df, path)
    return read_table(spark, path)

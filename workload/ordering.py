"""Sorts, first and last rows, duplicates, and column selection."""

from tablewright import (
    drop_columns,
    drop_invalid,
    inspect,
    limit,
    preview,
    profile,
    remove_duplicates,
    rename_columns,
    select_columns,
    sort,
    with_positions,
)
from workload.base import MESSY, PLACED, query, register, source


@query("select * from orders order by o_totalprice desc, o_orderkey limit 100")
def sort_top_n(spark, sf):
    return limit(sort(source(spark, sf, "orders", "o_orderkey"), ["o_totalprice"], ["desc"]), 100)


@query("select * from messy_customer order by cast(level as double) nulls last, c_custkey limit 200")
def sort_numbers_in_text_top_n(spark, sf):
    return limit(sort(source(spark, sf, "messy_customer", "c_custkey"), ["level"]), 200)


@query("select * from messy_customer order by lower(segment) desc nulls last, c_acctbal desc nulls last, c_custkey limit 150")
def sort_text_then_number_top_n(spark, sf):
    return limit(sort(source(spark, sf, "messy_customer", "c_custkey"), ["segment", "c_acctbal"], ["desc", "desc"]), 150)


@query(f"""select * exclude (r) from (select *, row_number() over (order by {PLACED} desc nulls last, o_orderkey) as r
           from messy_orders where placed is null or {PLACED} is not null) where r <= 80""")
def sort_dates_in_text_top_n(spark, sf):
    # Cells that are no date make a column text, so the plan drops them first, as a user's would.
    dated = drop_invalid(source(spark, sf, "messy_orders", "o_orderkey"), ["placed"], "date")
    return limit(sort(dated, ["placed"], ["desc"]), 80)


@query("""select o_orderkey, o_orderpriority, o_totalprice,
          row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) - 1 as position from orders""")
def sort_positions(spark, sf):
    placed = sort(source(spark, sf, "orders", "o_orderkey"), ["o_orderpriority", "o_totalprice"], ["asc", "desc"])
    return with_positions(placed).select("o_orderkey", "o_orderpriority", "o_totalprice", "__tw_position").withColumnRenamed(
        "__tw_position", "position"
    )


@query("select * from part order by p_partkey limit 25")
def limit_first(spark, sf):
    return limit(source(spark, sf, "part", "p_partkey"), 25)


@query("select * from part order by p_retailprice desc, p_partkey desc limit 40")
def limit_last_of_sorted(spark, sf):
    return limit(sort(source(spark, sf, "part", "p_partkey"), ["p_retailprice"]), 40, from_end=True)


@query("select * from messy_customer qualify row_number() over (partition by lower(trim(segment)) order by c_custkey) = 1")
def dedupe_key_first(spark, sf):
    return remove_duplicates(source(spark, sf, "messy_customer", "c_custkey"), ["segment"])


@query("""select * from messy_customer
          qualify row_number() over (partition by lower(trim(segment)), c_nationkey order by c_acctbal desc nulls last, c_custkey) = 1""")
def dedupe_two_keys_after_sort(spark, sf):
    ranked = sort(source(spark, sf, "messy_customer", "c_custkey"), ["c_acctbal"], ["desc"])
    return remove_duplicates(ranked, ["segment", "c_nationkey"])


@query("select * from documents qualify row_number() over (partition by lower(trim(text)) order by doc_id) = 1")
def dedupe_documents(spark, sf):
    return remove_duplicates(source(spark, sf, "documents", "doc_id"), ["text"])


@query("select distinct o_orderstatus, o_orderpriority from orders")
def dedupe_rows(spark, sf):
    return remove_duplicates(select_columns(source(spark, sf, "orders", "o_orderkey"), ["o_orderstatus", "o_orderpriority"]))


@query("select o_totalprice, o_orderkey from orders")
def columns_select(spark, sf):
    return select_columns(source(spark, sf, "orders"), ["o_totalprice", "o_orderkey"])


@query("select * exclude (p_name, p_size) from part")
def columns_drop(spark, sf):
    return drop_columns(source(spark, sf, "part"), ["p_size", "p_name"])


@query("""select s_suppkey as "Supplier No.", s_name as "Name", s_nationkey, s_acctbal from supplier""")
def columns_rename(spark, sf):
    return rename_columns(source(spark, sf, "supplier"), ["s_suppkey", "s_name"], ["Supplier No.", "Name"])


_TYPES = {"c_custkey": "integer", "c_name": "text", "c_nationkey": "integer", "c_acctbal": "number", "segment": "text",
          "points": "text", "level": "number", "code": "text"}
_PROFILE = " union all ".join(
    f"select {i} as position, '{c}' as \"column\", '{_TYPES[c]}' as type, count(*) as rows, count({c}) as non_null, "
    f"count(*) filter ({c} is null or trim(cast({c} as string)) = '') as blank_cells from messy_customer"
    for i, c in enumerate(MESSY["messy_customer"][2])
)


@query(_PROFILE)
def profile_types(spark, sf):
    return profile(source(spark, sf, "messy_customer"))


@query("select * from events order by event_id limit 5")
def inspect_sample(spark, sf):
    return inspect(source(spark, sf, "events", "event_id")).sample


register(
    "preview_first_rows",
    lambda spark, sf: preview(sort(source(spark, sf, "supplier", "s_suppkey"), ["s_acctbal"]), 8),
    "select * from supplier order by s_acctbal, s_suppkey limit 8",
)

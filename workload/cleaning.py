"""Missing and invalid cells, white space, replacement, and display formats."""

from tablewright import (
    drop_invalid,
    drop_missing,
    fill_missing,
    find_replace,
    flag_missing,
    format_cells,
    missing_report,
    offenders,
    select_columns,
    trim,
    with_row_order,
)
from workload.base import PLACED, POINTS, query, source

# Every white space character, in the oracle's regular expressions.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query("select * replace (case when segment is null or trim(segment) = '' then 'Unknown' else segment end as segment) from messy_customer")
def fill_text(spark, sf):
    return fill_missing(source(spark, sf, "messy_customer"), ["segment"], "Unknown")


@query("select * replace (coalesce(c_acctbal, 0) as c_acctbal) from messy_customer")
def fill_number(spark, sf):
    return fill_missing(source(spark, sf, "messy_customer"), ["c_acctbal"], "0")


@query("""select s_suppkey, case when s_nationkey % 4 = 0 then 'none' else cast(s_nationkey as string) end as nation from supplier""")
def fill_number_with_text(spark, sf):
    gaps = source(spark, sf, "supplier").selectExpr("s_suppkey", "case when s_nationkey % 4 <> 0 then s_nationkey end as nation")
    return fill_missing(gaps, ["nation"], "none")


_KIND = "case when trim(kind) <> '' then kind end"


@query(f"""select event_id, user_id, last_value({_KIND} ignore nulls) over w as kind, last_value(amount ignore nulls) over w as amount
           from messy_events window w as (order by event_id rows between unbounded preceding and current row)""")
def fill_previous(spark, sf):
    return fill_missing(source(spark, sf, "messy_events", "event_id"), ["kind", "amount"], fill_method="previous")


@query(f"""select event_id, user_id, first_value({_KIND} ignore nulls) over w as kind, first_value(amount ignore nulls) over w as amount
           from messy_events window w as (order by event_id rows between current row and unbounded following)""")
def fill_next(spark, sf):
    return fill_missing(source(spark, sf, "messy_events", "event_id"), ["kind", "amount"], fill_method="next")


@query("""select * replace (last_value(c_acctbal ignore nulls)
          over (order by c_custkey rows between unbounded preceding and current row) as c_acctbal) from messy_customer""")
def fill_previous_in_stored_order(spark, sf):
    return fill_missing(with_row_order(source(spark, sf, "messy_customer")), ["c_acctbal"], fill_method="previous")


@query("""select * from messy_customer where segment is not null and trim(segment) <> '' and c_acctbal is not null""")
def drop_missing_in_columns(spark, sf):
    return drop_missing(source(spark, sf, "messy_customer"), ["segment", "c_acctbal"])


@query("""select * from messy_events where kind is not null and trim(kind) <> '' and amount is not null""")
def drop_missing_anywhere(spark, sf):
    return drop_missing(source(spark, sf, "messy_events"))


@query(f"select * from messy_customer where points is null or trim(points) = '' or {POINTS} is not null")
def drop_invalid_numbers(spark, sf):
    return drop_invalid(source(spark, sf, "messy_customer"), ["points"])


@query(f"select * from messy_orders where placed is null or {PLACED} is not null")
def drop_invalid_dates(spark, sf):
    return drop_invalid(source(spark, sf, "messy_orders"), ["placed"], "date")


@query(f"select distinct points as value from messy_customer where trim(points) <> '' and {POINTS} is null")
def invalid_examples(spark, sf):
    return offenders(source(spark, sf, "messy_customer", "c_custkey"), "points")


@query("""select 'segment' as "column", count(*) filter (segment is null or trim(segment) = '') as blank_cells from messy_customer
          union all select 'c_acctbal', count(*) filter (c_acctbal is null) from messy_customer
          union all select 'points', count(*) filter (points is null or trim(points) = '') from messy_customer""")
def missing_cells_report(spark, sf):
    return missing_report(source(spark, sf, "messy_customer"), ["segment", "c_acctbal", "points"])


@query("""select *, kind is null or trim(kind) = '' as kind__is_blank, amount is null as amount__is_blank from messy_events""")
def missing_cells_flagged(spark, sf):
    return flag_missing(source(spark, sf, "messy_events"), ["kind", "amount"])


@query(rf"""select doc_id, trim(regexp_replace(lang, '{_SPACE}', ' ', 'g')) as lang,
            trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) as text from messy_documents""")
def trim_documents(spark, sf):
    return trim(source(spark, sf, "messy_documents"))


@query("select * replace (regexp_replace(p_name, 'ring', '<R$1>', 'gi') as p_name) from part")
def replace_any_case(spark, sf):
    return find_replace(source(spark, sf, "part"), "RING", "<R$1>", "p_name")


@query("select * replace (replace(p_brand, 'Brand#1', 'B.') as p_brand) from part")
def replace_same_case(spark, sf):
    return find_replace(source(spark, sf, "part"), "Brand#1", "B.", "p_brand", match_case=True)


@query("select * replace (case when lower(trim(segment)) = 'building' then 'Construction' else segment end as segment) from messy_customer")
def replace_whole_cells(spark, sf):
    return find_replace(source(spark, sf, "messy_customer"), " building", "Construction", "segment", whole_cell=True)


@query("""select * replace (regexp_replace(p_name, 'a', '', 'gi') as p_name, regexp_replace(p_brand, 'a', '', 'gi') as p_brand,
          regexp_replace(p_type, 'a', '', 'gi') as p_type) from part""")
def replace_in_all_text(spark, sf):
    return find_replace(source(spark, sf, "part"), "A", "")


@query("select * replace (replace(cast(p_size as string), '1', 'one') as p_size) from part")
def replace_in_numbers(spark, sf):
    return find_replace(source(spark, sf, "part"), "1", "one", "p_size")


@query("select doc_id, regexp_replace(text, 'the ', 'THE-', 'gi') as text from documents")
def replace_in_documents(spark, sf):
    return find_replace(select_columns(source(spark, sf, "documents"), ["doc_id", "text"]), "The ", "THE-", "text")


@query("""select c_custkey, c_acctbal, case when c_acctbal < 0 then '-' else '' end || '$' || format('{:,.2f}', abs(c_acctbal))
          as c_acctbal_display from customer""")
def format_currency(spark, sf):
    return format_cells(select_columns(source(spark, sf, "customer"), ["c_custkey", "c_acctbal"]), ["c_acctbal"], "currency", currency_symbol="$")


@query("select o_orderkey, o_totalprice, format('{:,.1f}', o_totalprice) as o_totalprice_display from orders")
def format_number(spark, sf):
    return format_cells(select_columns(source(spark, sf, "orders"), ["o_orderkey", "o_totalprice"]), ["o_totalprice"], "number", decimals=1)


@query("select l_orderkey, l_discount, format('{:.0f}%', l_discount * 100) as l_discount_display from lineitem")
def format_percent(spark, sf):
    return format_cells(select_columns(source(spark, sf, "lineitem"), ["l_orderkey", "l_discount"]), ["l_discount"], "percent", decimals=0)


@query("select o_orderkey, o_orderdate, strftime(o_orderdate, '%d-%b-%Y') as o_orderdate_display from orders")
def format_date(spark, sf):
    columns = select_columns(source(spark, sf, "orders"), ["o_orderkey", "o_orderdate"])
    return format_cells(columns, ["o_orderdate"], "date", date_format="dd-mmm-yyyy")


@query(f"select o_orderkey, placed, coalesce(strftime({PLACED}, '%d-%m-%Y'), placed) as placed_display from messy_orders")
def format_dates_in_text(spark, sf):
    return format_cells(select_columns(source(spark, sf, "messy_orders"), ["o_orderkey", "placed"]), ["placed"], "date")

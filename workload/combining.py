"""Lookups, merges and edits."""

from pyspark.sql import functions as F

from tablewright import apply_edits, combine_sheets, lookup, merge, rename_columns, select_columns, set_cells, with_row_order
from workload.base import query, register, source

_BY_CODE = """
    select o.*, coalesce(c.c_name, 'Not found') as customer from messy_orders o
    left join (select lower(trim(code)) as k, c_name from messy_customer where trim(code) <> ''
               qualify row_number() over (partition by lower(trim(code)) order by c_custkey) = 1) c on lower(trim(o.code)) = c.k"""


def _by_code(spark, sf, **options):
    customers = source(spark, sf, "messy_customer", "c_custkey")
    return lookup(source(spark, sf, "messy_orders"), customers, "code", "code", "c_name", "customer", **options)


register("lookup_loose_keys", _by_code, _BY_CODE)
register("lookup_by_salted_shuffle", lambda spark, sf: _by_code(spark, sf, broadcast_bytes=0), _BY_CODE)


@query("""select s.*, coalesce(c.c_name, 'Not found') as c_name from supplier s
          left join (select c_nationkey, c_name from customer qualify row_number() over (partition by c_nationkey order by c_custkey) = 1) c
          on s.s_nationkey = c.c_nationkey""")
def lookup_first_match(spark, sf):
    return lookup(source(spark, sf, "supplier"), source(spark, sf, "customer", "c_custkey"), "s_nationkey", "c_nationkey", "c_name")


@query("""select l_orderkey, l_partkey, p_retailprice as price from lineitem left join part on l_partkey = p_partkey""")
def lookup_keeps_type(spark, sf):
    lines = select_columns(source(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])
    return lookup(lines, source(spark, sf, "part", "p_partkey"), "l_partkey", "p_partkey", "p_retailprice", "price", not_found=None)


@query("""select c.*, coalesce(n.n_name, 'Not found') as n_name from
          (select c_custkey, case when c_custkey % 4 = 0 then null else ' ' || cast(c_nationkey as string) || ' ' end as nation from customer) c
          left join nation n on trim(c.nation) = cast(n.n_nationkey as string)""")
def lookup_number_against_text(spark, sf):
    customers = source(spark, sf, "customer").selectExpr(
        "c_custkey", "case when c_custkey % 4 = 0 then null else ' ' || cast(c_nationkey as string) || ' ' end as nation"
    )
    return lookup(customers, source(spark, sf, "nation", "n_nationkey"), "nation", "n_nationkey", "n_name")


def _customer_as(spark, sf, *names):
    columns = select_columns(source(spark, sf, "customer"), ["c_custkey", "c_name", "c_acctbal"])
    return rename_columns(columns, ["c_custkey", "c_name", "c_acctbal"], names)


def _supplier_as(spark, sf, *names):
    columns = select_columns(source(spark, sf, "supplier"), ["s_suppkey", "s_name", "s_acctbal"])
    return rename_columns(columns, ["s_suppkey", "s_name", "s_acctbal"], names)


@query("""select c_custkey as "Account ID", c_name as "Name", c_acctbal as "Balance", null as "Nation" from customer
          union all select s_suppkey, s_name, s_acctbal, s_nationkey from supplier""")
def merge_stack(spark, sf):
    suppliers = rename_columns(
        source(spark, sf, "supplier"), ["s_suppkey", "s_name", "s_acctbal", "s_nationkey"], ["account_id", "NAME", "balance", "Nation"]
    )
    return merge({"customers": _customer_as(spark, sf, "Account ID", "Name", "Balance"), "suppliers": suppliers})


@query("""select c_custkey as "Party", c_name as "Name", c_acctbal as "Balance" from customer
          union all select s_suppkey, s_name, s_acctbal from supplier""")
def merge_synonyms(spark, sf):
    tables = {
        "customers": _customer_as(spark, sf, "client_no", "Name", "Balance"),
        "suppliers": _supplier_as(spark, sf, "vendor", "Name", "Balance"),
    }
    return merge(tables, column_groups=[{"name": "Party", "aliases": ["client_no", "vendor"]}])


@query("""select cast(c_custkey as string) as id, c_name as name from customer union all select 'S' || cast(s_suppkey as string), s_name from supplier""")
def merge_type_conflict(spark, sf):
    customers = source(spark, sf, "customer").selectExpr("c_custkey as id", "c_name as name")
    suppliers = source(spark, sf, "supplier").selectExpr("'S' || cast(s_suppkey as string) as id", "s_name as name")
    return merge({"customers": customers, "suppliers": suppliers})


@query("""select p.p_partkey, p.p_name, s.s_suppkey, s.s_name from (select *, row_number() over (order by p_partkey) as r from part) p
          full join (select *, row_number() over (order by s_suppkey) as r from supplier) s on p.r = s.r""")
def merge_side_by_side(spark, sf):
    parts = select_columns(source(spark, sf, "part", "p_partkey"), ["p_partkey", "p_name"])
    suppliers = select_columns(with_row_order(source(spark, sf, "supplier")), ["s_suppkey", "s_name"])
    return merge({"parts": parts, "suppliers": suppliers})


@query("""select 'nation list' as sheet, n_nationkey as k, n_name as name from nation union all select 'region', r_regionkey, r_name from region""")
def combined_sheets(spark, sf):
    sheets = combine_sheets({"nation/list": source(spark, sf, "nation"), "region": source(spark, sf, "region")})
    rows = [df.select(F.lit(label).alias("sheet"), F.col(df.columns[0]).alias("k"), F.col(df.columns[1]).alias("name")) for label, df in sheets.items()]
    return rows[0].unionByName(rows[1])


_EDITS = [
    {"row": 0, "column": "p_name", "value": "first part"},
    {"row": 3, "column": "p_size", "value": "99"},
    {"row": 3, "column": "p_size", "value": "42"},
    {"row": 7, "column": "p_retailprice", "value": "12.5"},
    {"row": 9, "column": "p_brand", "value": " "},
    {"row": 10**9, "column": "p_name", "value": "nowhere"},
]


@query("""select * exclude (r) replace (case when r = 0 then 'first part' else p_name end as p_name, case when r = 3 then 42 else p_size end as p_size,
          case when r = 7 then 12.5::double else p_retailprice end as p_retailprice, case when r = 9 then null else p_brand end as p_brand)
          from (select *, row_number() over (order by p_partkey) - 1 as r from part)""")
def edit_cells_by_position(spark, sf):
    return set_cells(source(spark, sf, "part", "p_partkey"), _EDITS)


@query("""select p.* replace (case when s.s_suppkey is null then p_name else 'from ' || s_name end as p_name,
          case when s.s_suppkey is null then p_retailprice else s_acctbal end as p_retailprice)
          from part p left join supplier s on p.p_partkey = s.s_suppkey * 3""")
def edit_cells_by_key(spark, sf):
    supplier = source(spark, sf, "supplier")
    names = supplier.selectExpr("s_suppkey * 3 as p_partkey", "'p_name' as column", "'from ' || s_name as value", "s_suppkey as seq")
    prices = supplier.selectExpr("s_suppkey * 3 as p_partkey", "'p_retailprice' as column", "cast(s_acctbal as string) as value", "s_suppkey as seq")
    return apply_edits(source(spark, sf, "part"), names.unionByName(prices), ["p_partkey"])

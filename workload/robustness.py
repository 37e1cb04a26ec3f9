"""Queries that look for lost or altered data: fractions, nested columns, many labels, ragged files, zones, refusals."""

from pyspark.sql import functions as F

from tablewright import (
    OperationError,
    add_formula_column,
    combine_sheets,
    drop_invalid,
    fill_missing,
    filter_rows,
    find_replace,
    format_mismatches,
    limit,
    lookup,
    read_table,
    read_tables,
    remove_duplicates,
    run_plan,
    sort,
    write_table,
)
from tablewright.operators.roworder import scratch_path
from workload.base import query, register, source

# Numbers from 1e-6 to 1e20 in plain digits, by the same SQL in both engines.
_DIGITS = (
    "case when c_custkey % 3 = 0 then cast(c_custkey + 3 as string) || '00000000000000' "
    "when c_custkey % 3 = 1 then cast(c_custkey as string) || '000000.5' "
    "else '0.' || regexp_replace(lpad(cast(c_custkey as string), 6, '0'), '0+$', '') end"
)


@query(f"""select c_custkey, cast({_DIGITS} as double) as x, c_name as found from customer""")
def lookup_fractional_keys(spark, sf):
    customers = source(spark, sf, "customer")
    keyed = customers.selectExpr("c_custkey", f"cast({_DIGITS} as double) as x")
    digits = source(spark, sf, "customer", "c_custkey").selectExpr(f"{_DIGITS} as digits", "c_name", "*")
    return lookup(keyed, digits.drop("c_custkey"), "x", "digits", "c_name", "found")


_PLAIN = "cast(p_partkey as string) || '000000.0'"


@query(f"select p_partkey, cast({_PLAIN} as double) as x from part where contains({_PLAIN}, '1000') or p_partkey % 7 = 0 and ends_with({_PLAIN}, '0.0')")
def filter_contains_in_numbers(spark, sf):
    parts = source(spark, sf, "part").selectExpr("p_partkey", f"cast({_PLAIN} as double) as x", "p_partkey % 7 as seventh")
    ends = filter_rows(parts, [{"column": "x", "operator": "ends_with", "value": "0.0"}, {"column": "seventh", "operator": "equals", "value": 0}])
    holds = filter_rows(parts, [{"column": "x", "operator": "contains", "value": "1000"}])
    return ends.unionByName(holds).distinct().drop("seventh")


@query("select p_partkey, replace(cast(p_partkey + 1 as string) || '000000.5', '9', '88') as x from part")
def replace_in_fractions(spark, sf):
    parts = source(spark, sf, "part").selectExpr("p_partkey", "cast(p_partkey + 1 as string) || '000000.5' as digits")
    parts = parts.selectExpr("p_partkey", "cast(digits as double) as x")
    return find_replace(parts, "9", "88", "x")


@query("""select label, cast(cast(floor(embedding[1] * 4) as bigint) as string) || ',' || cast(cast(floor(embedding[2] * 4) as bigint) as string) as place, min(vec_id) as vec_id
          from embeddings group by all""")
def dedupe_nested(spark, sf):
    vectors = source(spark, sf, "embeddings", "vec_id")
    rough = vectors.withColumn("embedding", F.transform(F.slice("embedding", 1, 2), lambda x: F.floor(x * 4)))
    first = remove_duplicates(rough.withColumn("kept_id", F.col("vec_id")).drop("vec_id").withColumnRenamed("kept_id", "__tw_vec"))
    return first.select("label", F.array_join("embedding", ",").alias("place"), F.col("__tw_vec").alias("vec_id"))


_SHEETS = 110
_SHEET_STEM = "remainder class of customers "[:28]


@query(f"""select case when i = 0 then '{_SHEET_STEM}' else substr('{_SHEET_STEM}', 1, 30 - length(cast(i + 1 as string))) || ' ' || cast(i + 1 as string) end as sheet,
          c_custkey, c_name from (select *, c_custkey % {_SHEETS} as i from customer)""")
def combined_many_sheets(spark, sf):
    customers = source(spark, sf, "customer").select("c_custkey", "c_name")
    classes = {f"remainder class of customers {i:05d}": customers.where(F.col("c_custkey") % _SHEETS == i) for i in range(_SHEETS)}
    sheets = [df.withColumn("sheet", F.lit(label)) for label, df in combine_sheets(classes).items()]
    while len(sheets) > 1:
        sheets = [a.unionByName(b) for a, b in zip(sheets[::2], sheets[1::2], strict=False)] + sheets[len(sheets) // 2 * 2 :]
    return sheets[0]


@query("select l_orderkey, l_linenumber, l_orderkey + 9007199254740992 as big from lineitem")
def fill_fraction_without_blanks(spark, sf):
    lines = source(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey + 9007199254740992 as big")
    return fill_missing(lines, ["big"], "0.5")


@query("select doc_id, text, n_chars from documents")
def csv_with_line_breaks(spark, sf):
    path = f"{scratch_path(spark)}.csv"
    write_table(source(spark, sf, "documents").select("doc_id", "text", "n_chars"), path)
    return read_table(spark, path)


def _text_file(spark, rows, *head):
    """A file that begins with the lines `head`, before the given lines."""
    path = f"{scratch_path(spark)}.csv"
    first = spark.createDataFrame([(i, line) for i, line in enumerate(head)], "n long, line string")
    lines = first.unionByName(rows.selectExpr(f"n + {len(head)} as n", "line"))
    lines.orderBy("n").coalesce(1).sortWithinPartitions("n").select("line").write.text(path)
    return path


_NATION_LINE = "cast(n_nationkey as string) || ',' || n_name || ',' || cast(n_regionkey as string)"


@query('select n_nationkey as "Key", n_name as "Nation", n_regionkey as "Region" from nation')
def csv_title_row(spark, sf):
    rows = source(spark, sf, "nation").selectExpr("n_nationkey as n", f"{_NATION_LINE} as line")
    return read_table(spark, _text_file(spark, rows, "All nations,,", "Key,Nation,Region"))


@query('select n_name as "Nation", n_regionkey as "Column B", n_nationkey as "Code" from nation')
def csv_phantom_and_blank_headers(spark, sf):
    line = "',' || n_name || ',' || cast(n_regionkey as string) || ',' || cast(n_nationkey as string)"
    rows = source(spark, sf, "nation").selectExpr("n_nationkey as n", f"{line} as line")
    return read_table(spark, _text_file(spark, rows, ",Nation,,Code"))


@query('select n_nationkey as "Key", n_name as "Name", n_regionkey as "Key.1" from nation')
def csv_repeated_headers(spark, sf):
    rows = source(spark, sf, "nation").selectExpr("n_nationkey as n", f"{_NATION_LINE} as line")
    return read_table(spark, _text_file(spark, rows, "Key,Name,Key"))


@query("""select 'customer' as table_name, c_custkey as k, c_name as name from customer union all select 'customer (2)', s_suppkey, s_name from supplier""")
def tables_read_by_name(spark, sf):
    one, other = (f"{scratch_path(spark)}/customer.parquet" for _ in range(2))
    source(spark, sf, "customer").selectExpr("c_custkey as k", "c_name as name").write.parquet(one)
    source(spark, sf, "supplier").selectExpr("s_suppkey as k", "s_name as name").write.parquet(other)
    a, b = [df.withColumn("table_name", F.lit(name)) for name, df in read_tables(spark, [one, other]).tables.items()]
    return a.select("table_name", "k", "name").unionByName(b.select("table_name", "k", "name"))


def _zoned(spark, sf, bad="null"):
    moment = "date_format(o_orderdate, 'yyyy-MM-dd')"
    return source(spark, sf, "orders", "o_orderkey").selectExpr(
        "o_orderkey",
        f"case when o_orderkey % 11 = 0 then {bad} when o_orderkey % 3 = 0 then {moment} || 'T00:30:00Z' "
        f"when o_orderkey % 3 = 1 then {moment} || 'T00:30:00+02:00' else {moment} || ' 00:30:00.123456789' end as shown",
    )


_ZONED_SQL = (
    "select o_orderkey, case when o_orderkey % 11 = 0 then {bad} when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y-%m-%d') || 'T00:30:00Z' "
    "when o_orderkey % 3 = 1 then strftime(o_orderdate, '%Y-%m-%d') || 'T00:30:00+02:00' else strftime(o_orderdate, '%Y-%m-%d') || ' 00:30:00.123456789' end as shown, "
    "o_orderdate + interval 30 minutes - case when o_orderkey % 3 = 1 then interval 2 hours else interval 0 hours end as moment from orders"
)


@query(f"select o_orderkey, shown from ({_ZONED_SQL.format(bad='null')}) where o_orderkey % 11 <> 0 and moment >= timestamp '1996-07-01 00:00:00'")
def filter_zoned_dates(spark, sf):
    return filter_rows(_zoned(spark, sf), [{"column": "shown", "operator": "greater_or_equal", "value": "1996-07-01"}])


_FAR = "'some day, but after so many words that no one would still take them for a date'"


@query(f"select o_orderkey, shown from ({_ZONED_SQL.format(bad=_FAR)}) where o_orderkey % 11 <> 0")
def drop_invalid_zoned_dates(spark, sf):
    return drop_invalid(_zoned(spark, sf, _FAR), ["shown"], "date")


@query("select * from orders order by o_totalprice desc, o_orderkey limit 5000")
def limit_many_rows(spark, sf):
    return limit(sort(source(spark, sf, "orders", "o_orderkey"), ["o_totalprice"], ["desc"]), 5000)


def _lines_by_part(spark, sf, **options):
    lines = source(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "case when l_partkey % 5 = 0 then null else l_partkey % 700 end as part")
    return lookup(lines, source(spark, sf, "part", "p_partkey"), "part", "p_partkey", "p_name", **options)


# Nearly every key has more rows than hot_rows, so the join runs by salts of several hundred keys.
register(
    "lookup_hot_keys",
    lambda spark, sf: _lines_by_part(spark, sf, broadcast_bytes=0, hot_rows=4),
    """select l_orderkey, l_linenumber, part, coalesce(p_name, 'Not found') as p_name from
       (select l_orderkey, l_linenumber, case when l_partkey % 5 = 0 then null else l_partkey % 700 end as part from lineitem) left join part on part = p_partkey""",
)


@query("""select * from (values ('format of text', true), ('format of numbers', false), ('text times two', true), ('name that exists', true), ('import in a formula', true),
          ('unknown column in a formula', true), ('unknown column', true), ('unknown action', true), ('good formula', false)) t(operation, refused), (select count(*) as n_rows from part)""")
def refused_operations(spark, sf):
    parts = source(spark, sf, "part", "p_partkey")

    def refused(call):
        try:
            call()
        except OperationError:
            return True
        return False

    found = [
        ("format of text", bool(format_mismatches(parts, ["p_name"], "date"))),
        ("format of numbers", bool(format_mismatches(parts, ["p_size"], "number"))),
        ("text times two", refused(lambda: add_formula_column(parts, "x", "{p_name} * 2"))),
        ("name that exists", refused(lambda: add_formula_column(parts, "p_size", "{p_size} * 2"))),
        ("import in a formula", refused(lambda: add_formula_column(parts, "x", "__import__('os').getcwd()"))),
        ("unknown column in a formula", refused(lambda: add_formula_column(parts, "x", "{p_weight} + 1"))),
        ("unknown column", refused(lambda: run_plan(parts, operations=[{"action": "sort", "columns": ["p_weight"]}]))),
        ("unknown action", refused(lambda: run_plan(parts, operations=[{"action": "weigh"}]))),
        ("good formula", refused(lambda: add_formula_column(parts, "x", "{p_size} * 2"))),
    ]
    outcomes = F.array(*[F.struct(F.lit(name).alias("operation"), F.lit(no).alias("refused")) for name, no in found])
    return parts.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(outcomes), "n_rows")

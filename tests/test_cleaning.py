import math
from decimal import Decimal
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewright import (
    OperationError,
    drop_columns,
    drop_invalid,
    drop_missing,
    fill_missing,
    filter_rows,
    find_replace,
    flag_missing,
    missing_report,
    offenders,
    remove_duplicates,
    rename_columns,
    select_columns,
    sort,
    trim,
    visible,
    with_row_order,
)
from tablewright.operators.missing import fill_from_neighbour


def test_columns(table, rows):
    df = table("a long, b long, c long", [(1, 2, 3)])
    assert visible(select_columns(df, ["c", "a"])).columns == ["c", "a"]
    assert visible(drop_columns(df, ["b"])).columns == ["a", "c"]
    assert visible(rename_columns(df, ["a", "b"], ["b", "a"])).columns == ["b", "a", "c"]
    assert rows(rename_columns(df, ["a", "b"], ["b", "a"])) == [(1, 2, 3)]
    for call in (
        lambda: select_columns(df, []),
        lambda: select_columns(df, ["a", "a"]),
        lambda: select_columns(df, ["x"]),
        lambda: drop_columns(df, []),
        lambda: drop_columns(df, ["A"]),
        lambda: rename_columns(df, ["a"], []),
        lambda: rename_columns(df, ["a"], ["b"]),
        lambda: rename_columns(df, ["x"], ["y"]),
    ):
        with pytest.raises(OperationError):
            call()


def test_duplicates(table, rows):
    assert rows(remove_duplicates(table("e string", ["Box 7 ", "BOX 7", " box 7"]))) == ["Box 7 "]
    df = table("Tag string, Mark long", [("p", 31), ("p", 76), ("q", 2)])
    assert rows(remove_duplicates(df, ["Tag"])) == [("p", 31), ("q", 2)]
    assert rows(remove_duplicates(df)) == [("p", 31), ("p", 76), ("q", 2)]
    assert rows(remove_duplicates(sort(df, ["Mark"], ["desc"]), ["Tag"])) == [("p", 76), ("q", 2)]
    assert rows(remove_duplicates(table("e string", [None, "", None, " "]))) == [None, ""]
    assert len(rows(remove_duplicates(table("x double", [float("nan"), None, 1.0, 1.0])))) == 2


def test_nested_columns_tell_rows_apart(table, rows):
    df = table("k long, v array<double>", [(1, [1.0]), (1, [2.0]), (1, [1.0]), (2, None)])
    assert len(rows(remove_duplicates(df))) == 3 and len(rows(remove_duplicates(df.drop("k")))) == 3
    assert rows(drop_missing(df), "k") == [1, 1, 1] and len(rows(drop_missing(df.drop("k")))) == 3
    with pytest.raises(OperationError, match="Maps"):
        remove_duplicates(table("m map<string, int>", [({"a": 1},)]))


def test_a_fraction_is_filled_only_where_there_is_a_gap(table, rows):
    big = 9007199254740993
    assert rows(fill_missing(table("n long", [big, 2]), ["n"], "0.5")) == [big, 2]


def test_replacing_in_fractions_leaves_other_cells(table, rows):
    df = table("x double", [12345678.5, 9.0, None, 2e-5])
    assert rows(find_replace(df, "9", "8", "x")) == ["12345678.5", "8.0", None, "0.00002"]


def test_duplicates_send_one_row_per_key(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(10).selectExpr("id", "'x' as k").write.parquet(path)
    plan = remove_duplicates(spark.read.parquet(path), ["k"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_fill_value(table, rows):
    df = table("R string, k long, x double, d timestamp_ntz", [("x", 1, 1.5, datetime(2025, 1, 1)), (None, None, float("nan"), None), ("", 3, None, None)])
    assert rows(fill_missing(df, ["R"], "Unknown"), "R") == ["x", "Unknown", "Unknown"]
    assert rows(fill_missing(df, ["k"], "0"), "k") == [1, 0, 3]
    assert rows(fill_missing(df, ["k"], "0.5"), "k") == [1.0, 0.5, 3.0]
    assert rows(fill_missing(df, ["x"], "2"), "x") == [1.5, 2.0, 2.0]
    assert rows(fill_missing(df, ["k"], "none"), "k") == ["1", "none", "3"]
    assert rows(fill_missing(df, ["d"], "02/01/2025"), "d")[1] == datetime(2025, 2, 1)
    full = table("k long", [1, 2])
    assert rows(fill_missing(full, None, "none")) == [1, 2]
    with pytest.raises(OperationError, match="fill"):
        fill_missing(df, ["R"])


@pytest.mark.parametrize("bits", [0, 1, 20])
@pytest.mark.parametrize(
    "forward, given, expected",
    [
        (True, ["m", "", None, None, "n", ""], ["m", "m", "m", "m", "n", "n"]),
        (True, [" ", "x", None], [None, "x", "x"]),
        (False, [None, "m", " ", "n", None, None], ["m", "m", "n", "n", None, None]),
        (False, [None, "x", "  "], ["x", "x", None]),
        (True, [None, None, None], [None, None, None]),
        (True, ["a", None, None, None, None, None, None], ["a"] * 7),
        (False, [None, None, None, None, None, None, "z"], ["z"] * 7),
    ],
)
def test_fill_from_neighbour(table, rows, bits, forward, given, expected):
    assert rows(fill_from_neighbour(table("v string", given), ["v"], forward, bits)) == expected


def test_fill_over_many_files_matches_pandas(spark, rows, tmp_path):
    path = str(tmp_path / "f")
    cells = "case when id % 7 in (0, 3) then cast(id as string) when id % 5 = 0 then ' ' end"
    spark.range(500).repartitionByRange(6, "id").sortWithinPartitions("id").selectExpr(
        "id", f"{cells} as s", "if(id between 100 and 300, null, id) as n"
    ).write.parquet(path)
    df = spark.read.parquet(path)
    plain = df.toPandas().sort_values("id")
    plain["s"] = plain["s"].where(plain["s"].str.strip() != "", None)
    for method, pandas_fill in (("previous", "ffill"), ("next", "bfill")):
        wanted = getattr(plain, pandas_fill)()
        filled = rows(fill_from_neighbour(df, ["s", "n"], method == "previous", bits=3))
        assert [r[1] for r in filled] == [None if v != v else v for v in wanted["s"]]
        assert [r[2] for r in filled] == [None if v != v else int(v) for v in wanted["n"]]


def test_fill_next_computes_no_frame_anew_for_each_row(spark):
    df = with_row_order(spark.range(3).selectExpr("id", "cast(null as string) as s"))
    plan = fill_missing(df, ["s"], fill_method="next")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_fill_follows_a_sort(table, rows):
    df = sort(table("k long, v string", [(3, None), (1, "a"), (2, None), (4, "b")]), ["k"], ["desc"])
    assert rows(fill_missing(df, ["v"], fill_method="previous")) == [(4, "b"), (3, "b"), (2, "b"), (1, "a")]


def test_missing(table, rows):
    df = table("R string, k long", [("x", 1), (None, 2), ("", 3)])
    assert rows(drop_missing(df)) == [("x", 1)]
    assert rows(drop_missing(df, ["k"])) == [("x", 1), (None, 2), ("", 3)]
    assert sorted(map(tuple, missing_report(df).collect())) == [("R", 2), ("k", 0)]
    assert rows(flag_missing(df, ["R"]), "R__is_blank") == [False, True, True]
    with pytest.raises(OperationError, match="Nope"):
        drop_missing(df, ["Nope"])


def test_invalid(table, rows):
    df = table("C string, Gauge string", list(zip("ABCDEFG", ["61.5", "lo", "8", "3B", "", "12D", "0x1p3"])))
    assert rows(drop_invalid(df, ["Gauge"]), "C") == ["A", "C", "E"]
    assert [r[0] for r in offenders(df, "Gauge").collect()] == ["lo", "3B", "12D", "0x1p3"]
    dates = table("D string", ["2031-07-09", "later", "Jul 12 2031", "2031-07-11T10:00:00.123456789+02:00", None])
    assert rows(drop_invalid(dates, ["D"], "date")) == ["2031-07-09", "Jul 12 2031", "2031-07-11T10:00:00.123456789+02:00", None]
    assert rows(drop_invalid(table("n long", [1, None]), ["n"])) == [1, None]
    with pytest.raises(OperationError):
        drop_invalid(df, [])


def test_trim(table, rows):
    df = table("Name string, Qty long", [("  Brest ", 1), ("Le \t Havre", 2), ("Nice", 3), (None, 4), ("  x", 5)])
    assert rows(trim(df)) == [("Brest", 1), ("Le Havre", 2), ("Nice", 3), (None, 4), ("x", 5)]
    assert rows(trim(df, ["Qty"])) == rows(df)


@pytest.mark.parametrize(
    "given, find, replace, options, expected",
    [
        (["d.r.", "dXrX"], "d.r.", "dr", {}, ["dr", "dXrX"]),
        (["Oslo", "oslo", "OSLO"], "oslo", "O", {}, ["O", "O", "O"]),
        (["Oslo", "oslo"], "oslo", "O", {"match_case": True}, ["Oslo", "O"]),
        (["Oslo", "Near Oslo", "Oslo ", " oslo"], "Oslo", "OSL", {"whole_cell": True}, ["OSL", "Near Oslo", "OSL", "OSL"]),
        (["Oslo ", "oslo"], "Oslo", "O", {"whole_cell": True, "match_case": True}, ["O", "oslo"]),
        (["toll"], "toll", "$7", {}, ["$7"]),
        (["toll"], "TOLL", r"\1$0", {}, [r"\1$0"]),
        (["cocoa"], "o", "0", {}, ["c0c0a"]),
        (["98-76", None], "-", "", {}, ["9876", None]),
        ([r"a\Eb", "aEb"], r"\E", "+", {}, ["a+b", "aEb"]),
        (["Größe", "GRÖSSE"], "ÖSS", "x", {}, ["Größe", "GRxE"]),
    ],
)
def test_replace(table, rows, given, find, replace, options, expected):
    assert rows(find_replace(table("c string", given), find, replace, "c", **options)) == expected


def test_replace_targets(table, rows):
    df = table("a string, b string, n long", [("x", "x", 1), ("y", "z", 21)])
    assert rows(find_replace(df, "x", "X")) == [("X", "X", 1), ("y", "z", 21)]
    assert rows(find_replace(df, "1", "9"), "n") == [1, 21]
    assert rows(find_replace(df, "1", "9", "n"), "n") == ["9", "29"]
    assert rows(find_replace(df, "7", "9", "n"), "n") == [1, 21]
    for options in ({"find": ""}, {"find": None}, {"find": "x", "column": "Nope"}):
        with pytest.raises(OperationError):
            find_replace(df, **options)


def test_operators_chain(table, rows):
    df = table("a string, n long", [(" x ", 1), ("y", 2), (None, 3)])
    out = df.transform(trim).transform(drop_missing).transform(filter_rows, [{"column": "n", "operator": "less_than", "value": 2}])
    assert rows(out) == [("x", 1)]


@pytest.mark.parametrize(
    ("kind", "value", "became", "cell"),
    [
        ("tinyint", "100", "tinyint", 100), ("tinyint", "300", "smallint", 300), ("tinyint", "-40000", "int", -40000),
        ("int", "99999999999", "bigint", 99999999999), ("bigint", "9223372036854775808", "decimal(38,0)", Decimal(2**63)),
        ("bigint", "9007199254740993", "bigint", 9007199254740993), ("int", "0.5", "double", 0.5), ("bigint", "1e400", "double", math.inf),
        ("decimal(5,2)", "12345.678", "decimal(8,3)", Decimal("12345.678")), ("decimal(5,2)", "1.239", "decimal(6,3)", Decimal("1.239")),
        ("decimal(5,2)", "7", "decimal(5,2)", Decimal(7)), ("decimal(38,2)", "0.001", "double", 0.001),
        ("float", "1e39", "double", 1e39), ("float", "0.5", "float", 0.5), ("double", "3", "double", 3.0), ("int", "1e3", "int", 1000),
        ("int", "soon", "string", "soon"),
    ],
)
def test_fills_and_edits_widen_a_column_as_far_as_needed(table, rows, kind, value, became, cell):
    from tablewright import set_cells

    df = table("s string", ["1", None]).withColumn("x", F.col("s").try_cast(kind)).drop("s")
    if not (kind == "bigint" and value == "1e400"):  # no finite number, so a fill takes it for text
        filled = fill_missing(df, ["x"], value)
        assert (dict(filled.dtypes)["x"], rows(filled, "x")[1]) == (became, cell)
        assert float(rows(filled, "x")[0]) == 1
        assert dict(fill_missing(df.where("x is not null"), ["x"], value).dtypes)["x"] == kind  # no gap, no change
    edited = set_cells(df, [{"row": 1, "column": "x", "value": value}])
    assert (dict(edited.dtypes)["x"], rows(edited, "x")[1]) == (became, cell)
    assert float(rows(edited, "x")[0]) == 1

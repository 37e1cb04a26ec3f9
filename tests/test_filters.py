from datetime import datetime

import pytest

from tablewright import Condition, OperationError, filter_rows

SHIPS = [
    ("Lund", 17, datetime(2031, 5, 3)),
    ("Brest", 64, datetime(2031, 6, 7)),
    ("Lund", 8, datetime(2031, 7, 9)),
    ("", 90, datetime(2031, 8, 11)),
    (None, 33, None),
]
ALL = [17, 64, 8, 90, 33]


@pytest.fixture
def ships(table):
    return table("Port string, Tons long, Docked timestamp_ntz", SHIPS)


def tons(rows, df, *conditions, **options):
    return rows(filter_rows(df, list(conditions), **options), "Tons")


@pytest.mark.parametrize(
    "column, operator, value, expected",
    [
        ("Port", "equals", " LUND ", [17, 8]),
        ("Port", "not_equals", "Lund", [64, 90, 33]),
        ("Port", "equals", None, []),
        ("Port", "not_equals", None, ALL),
        ("Port", "contains", "RES", [64]),
        ("Port", "starts_with", "lu", [17, 8]),
        ("Port", "ends_with", "ST", [64]),
        ("Port", "is_blank", None, [90, 33]),
        ("Port", "not_blank", None, [17, 64, 8]),
        ("Tons", "equals", "17", [17]),
        ("Tons", "equals", 17.0, [17]),
        ("Tons", "equals", "1.5", []),
        ("Tons", "equals", "many", []),
        ("Tons", "not_equals", "many", ALL),
        ("Tons", "contains", "3", [33]),
        ("Tons", "greater_than", "33", [64, 90]),
        ("Tons", "greater_than", "32.5", [64, 90, 33]),
        ("Tons", "less_than", "17", [8]),
        ("Tons", "greater_or_equal", "33", [64, 90, 33]),
        ("Tons", "less_or_equal", "17", [17, 8]),
        ("Docked", "greater_than", "2031-06-06", [64, 8, 90]),
        ("Docked", "less_or_equal", "Jun 7 2031", [17, 64]),
        ("Docked", "equals", "05/03/2031", [17]),
        ("Docked", "not_equals", "05/03/2031", [64, 8, 90, 33]),
    ],
)
def test_predicates(ships, rows, column, operator, value, expected):
    assert tons(rows, ships, Condition(column, operator, value)) == expected


def test_between_sorts_its_bounds(ships, rows):
    for low, high in (("17", "64"), ("64", "17")):
        assert tons(rows, ships, Condition("Tons", "between", low, high)) == [17, 64, 33]
    assert tons(rows, ships, Condition("Docked", "between", "2031-07-09", "2031-06-07")) == [64, 8]


def test_and_or(ships, rows):
    lund, heavy = Condition("Port", "equals", "lund"), Condition("Tons", "greater_than", 17)
    assert tons(rows, ships, lund, heavy) == []
    assert tons(rows, ships, lund, heavy, combine="or") == ALL
    blank = {"column": "Port", "operator": "is_blank"}
    assert tons(rows, ships, blank, heavy, combine="and") == [90, 33]


def test_membership(table, rows):
    df = table("Fruit string", ["Ripe", "Green", "Rotten", "ripe", "Sold", None])
    wanted = ["ripe", "GREEN "]
    assert rows(filter_rows(df, [Condition("Fruit", "in", values=wanted)])) == ["Ripe", "Green", "ripe"]
    assert rows(filter_rows(df, [Condition("Fruit", "not_in", values=wanted)])) == ["Rotten", "Sold", None]
    assert rows(filter_rows(df, [Condition("Fruit", "in", "sold")])) == ["Sold"]
    with pytest.raises(OperationError, match="list of values"):
        filter_rows(df, [Condition("Fruit", "in")])
    numbers = table("n long", [4, 6, 9])
    assert rows(filter_rows(numbers, [Condition("n", "in", values=["4", "9", "x"])])) == [4, 9]
    assert rows(filter_rows(numbers, [Condition("n", "not_in", values=["4", "9", "x"])])) == [6]


def test_text_that_means_numbers_or_dates(table, rows):
    numbers = table("Gauge string", ["73.5", "-8", "0", "640000001", "0.0032", "n.m.", "", None])
    assert rows(filter_rows(numbers, [Condition("Gauge", "greater_than", "0")])) == ["73.5", "640000001", "0.0032"]
    dates = table("Due string", ["07/09/2031", "2031-07-11", "Jul 12 2031", "13-Jul-2031", "2031/07/14", "soon"])
    assert rows(filter_rows(dates, [Condition("Due", "greater_than", "Jul 12 2031")])) == ["13-Jul-2031", "2031/07/14"]


def test_moments_with_zones_and_long_fractions(table, rows):
    given = ["2031-07-11T10:00:00Z", "2031-07-11T10:00:00+02:00", "2031-07-11 10:00:00.123456789", "2031-07-11T23:30:00-0100", " " * 80 + "2031-07-13"]
    df = table("At string", given)
    assert rows(filter_rows(df, [Condition("At", "less_than", "2031-07-11T10:00:00Z")])) == [given[1]]
    assert rows(filter_rows(df, [Condition("At", "greater_than", "2031-07-11T10:00:00.1Z")])) == given[2:]
    assert rows(filter_rows(df, [Condition("At", "between", "2031-07-12", "2031-07-12T00:30:00")])) == [given[3]]


def test_doubles_are_read_in_plain_digits(table, rows):
    df = table("x double", [12345678.5, 1e7, 0.0001, 1e20, -2.5e-7, 3.0])
    for wanted, found in [("1000", [1e7, 0.0001, 1e20][:1] + [1e20]), ("12345678.5", [12345678.5]), ("0.0001", [0.0001]), ("-0.00000025", [-2.5e-7]), ("e", [])]:
        assert rows(filter_rows(df, [Condition("x", "contains", wanted)])) == found
    assert rows(filter_rows(df, [Condition("x", "ends_with", ".0")])) == [1e7, 1e20, 3.0]


def test_truth_values_compare_as_numbers(table, rows):
    df = table("ok boolean, n long", [(True, 1), (False, 2), (None, 3)])
    assert rows(filter_rows(df, [Condition("ok", "greater_than", 0)]), "n") == [1]
    assert rows(filter_rows(df, [Condition("ok", "between", 0, 0.5)]), "n") == [2]


def test_nan_is_missing(table, rows):
    df = table("x double", [1.0, float("nan"), 3.0, None])
    assert rows(filter_rows(df, [Condition("x", "greater_than", 0)])) == [1.0, 3.0]
    assert len(rows(filter_rows(df, [Condition("x", "is_blank")]))) == 2


def test_only_the_right_case_of_a_name(table):
    df = table("a string, A string", [("x", "y"), ("y", "x")])
    assert [r[0] for r in filter_rows(df, [Condition("A", "equals", "x")]).collect()] == ["y"]
    with pytest.raises(OperationError, match="B"):
        filter_rows(df, [Condition("B", "equals", "x")])


def test_awkward_names(table, rows):
    df = table("`Seat No.` long, `a``b` string, `имя` string", [(1, "x", "Олег"), (2, "y", "Анна")])
    assert rows(filter_rows(df, [Condition("Seat No.", "greater_than", 1)]), "Seat No.") == [2]
    assert rows(filter_rows(df, [Condition("a`b", "equals", "X")]), "Seat No.") == [1]
    assert rows(filter_rows(df, [Condition("имя", "contains", "ЛЕ")]), "Seat No.") == [1]


def test_literal_substring(table, rows):
    df = table("t string", ["a.c", "abc", "A.C.", None])
    assert rows(filter_rows(df, [Condition("t", "contains", "a.c")])) == ["a.c", "A.C."]


def test_refusals(ships, table):
    for conditions, word in [
        ([], "at least one"),
        ([{"operator": "equals", "value": "x"}], "needs a column"),
        ([Condition("Port", "resembles", "x")], "resembles"),
        ([Condition("Nope", "equals", "x")], "Nope"),
        ([Condition("Port", "greater_than", "5")], "can't be compared"),
        ([Condition("Tons", "greater_than", "abc")], "can't be compared"),
        ([Condition("Docked", "less_than", "abc")], "date"),
        ([Condition("Port", "contains")], "needs a value"),
    ]:
        with pytest.raises(OperationError, match=word):
            filter_rows(ships, conditions)
    nested = table("a array<int>", [([1],)])
    with pytest.raises(OperationError, match="Nested"):
        filter_rows(nested, [Condition("a", "equals", "1")])


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_typed_comparisons_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).selectExpr("id", "cast(id as int) n", "timestamp_ntz'2025-01-01' + make_interval(0,0,0,id) d").write.parquet(path)
    df = spark.read.parquet(path)
    plan = plan_of(filter_rows(df, [Condition("n", "greater_than", "3"), Condition("id", "equals", "7")]))
    assert "GreaterThan(n,3)" in plan and "EqualTo(id,7)" in plan
    assert "GreaterThanOrEqual(d" in plan_of(filter_rows(df, [Condition("d", "between", "2025-01-03", "2025-01-02")]))

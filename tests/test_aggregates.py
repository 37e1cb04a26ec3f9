from datetime import datetime

import pytest

from tablewright import (
    OperationError,
    aggregate_answer,
    aggregate_by,
    aggregate_report,
    aggregate_table,
    limit,
    merge,
    sort,
    visible,
)


def answer(df, *args, **options):
    return aggregate_answer(df, *args, **options).value


def groups(df, *args, **options):
    return dict(tuple(r) for r in visible(aggregate_by(df, *args, **options)).collect())


def test_numeric(table):
    df = table("Revenue long, t string", [(100, "100"), (200, "200"), (50, "50")])
    assert answer(df, "sum", "Revenue") == 350 and answer(df, "sum", "t") == 350
    assert answer(df, "min", "Revenue") == 50 and answer(df, "max", "t") == 200
    scores = table("Score double", [10.0, None, 20.0, float("nan"), 30.0])
    for spelling in ("mean", "average", "avg", "AVG"):
        found = aggregate_answer(scores, spelling, "Score")
        assert (found.value, found.ignored, found.label) == (20, 2, "average_of_Score")
    assert "average of 'Score' is 20" in found.message and "2 blank" in found.message


def test_counts(table):
    df = table("Response string, Code long", [("Yes", 123), ("No", 456), ("yes", 123), (" YES ", None), ("", 1), (None, 2)])
    assert answer(df, "count") == 6
    assert answer(df, "count", "Response") == 4
    assert answer(df, "count", "Response", count_value="Yes") == 3
    assert answer(df, "count", "Response", count_value="Maybe") == 0
    assert answer(df, "count", "Code", count_value="123") == 2
    assert aggregate_table(df, "count", "Response", count_value="Yes").columns == ["count_of_Yes"]


def test_bad_cells_are_named(table):
    df = table("Revenue string", ["5000", "ABC", "7000", "12A", "", "ABC", None])
    found = aggregate_answer(df, "sum", "Revenue")
    assert (found.value, found.ignored, found.offenders) == (12000, 5, ["ABC", "12A"])
    assert "'ABC'" in found.message
    assert tuple(aggregate_report(df, "sum", "Revenue").first()) == (12000, 5)
    clean = aggregate_answer(table("x long", [1, 2]), "sum", "x")
    assert clean.message == "The sum of 'x' is 3."


def test_dates(table):
    df = table("d timestamp_ntz", [datetime(2025, 1, 1), datetime(2025, 3, 1), None])
    assert answer(df, "max", "d") == datetime(2025, 3, 1)
    with pytest.raises(OperationError, match="dates"):
        answer(df, "sum", "d")


def test_groups(table):
    df = table("Region string, Revenue long", [("North", 100), ("South", 50), ("North", 200), ("South", 25), ("North", 50)])
    assert groups(df, "sum", "Revenue", group_by=["Region"]) == {"North": 350, "South": 75}
    assert groups(df, "average", "Revenue", group_by=["Region"]) == {"North": 350 / 3, "South": 37.5}
    assert groups(df, "count", group_by=["Region"]) == {"North": 3, "South": 2}
    assert visible(aggregate_by(df, "avg", "Revenue", group_by=["Region"])).columns == ["Region", "average_of_Revenue"]
    assert visible(aggregate_by(df, "count", group_by=["Region"])).columns == ["Region", "count"]
    assert visible(aggregate_by(df, "count", "Revenue", group_by=["Region"])).columns == ["Region", "count_of_Revenue"]


def test_blank_groups(table):
    df = table("Region string, n int, Revenue string", [("North", 1, "10"), (None, 1, "20"), ("North", None, "30"), (None, None, "x"), ("", 2, "1")])
    assert groups(df, "sum", "Revenue", group_by=["Region"]) == {"North": 40, "(blank)": 20, "": 1}
    assert groups(df, "count", group_by=["n"]) == {1: 2, None: 2, 2: 1}
    assert groups(df, "count", group_by=["n"], label_blank=True) == {"1": 2, "(blank)": 2, "2": 1}


def test_groups_are_in_key_order(table, rows):
    df = table("g string, h long", [("b", 2), ("a", 1), ("c", 1), (None, 1), ("b", 1), ("a", 2), ("c", 2), (None, 2)])
    grouped = aggregate_by(df, "count", group_by=["g", "h"])
    assert rows(limit(grouped, 3)) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 1)]
    assert rows(limit(sort(grouped, ["count"], ["desc"]), 2)) == [("a", 1, 1), ("a", 2, 1)]
    assert rows(limit(grouped, 1, from_end=True)) == [("(blank)", 2, 1)]
    both = merge({"x": grouped, "y": aggregate_by(df, "count", group_by=["h"])})
    assert rows(both, "h", "count")[-2:] == [(1, 4), (2, 4)] and rows(both, "g")[:2] == ["a", "a"]


def test_grouped_count_of_a_value(table):
    df = table("Region string, Response string", [("N", "Yes"), ("S", "yes"), ("N", "No"), ("S", "Yes "), ("E", "No")])
    assert groups(df, "count", "Response", count_value="Yes", group_by=["Region"]) == {"N": 1, "S": 2}


def test_refusals(table):
    df = table("Name string, V long", [("Asha", 1)])
    for args, options, word in [
        (("median", "V"), {}, "median"), (("sum",), {}, "column"), (("count",), {"count_value": "x"}, "column"),
        (("sum", "Name"), {}, "text"), (("average", "Name"), {}, "average"), (("sum", "Nope"), {}, "Nope"), ((None, "V"), {}, "None"),
    ]:
        with pytest.raises(OperationError, match=word):
            aggregate_answer(df, *args, **options)
    with pytest.raises(OperationError, match="Nope"):
        aggregate_by(df, "sum", "V", group_by=["Nope"])
    with pytest.raises(OperationError, match="text"):
        aggregate_by(df, "sum", "Name", group_by=["V"])


def test_a_total_beyond_bigint_does_not_fail_the_job(table):
    assert answer(table("n long", [2**62, 2**62]), "sum", "n") is None


def test_groups_are_aggregated_before_the_shuffle(spark):
    plan = aggregate_by(spark.range(10).selectExpr("id % 2 as k", "id"), "sum", "id", group_by=["k"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("HashAggregate") == 2

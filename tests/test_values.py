from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from tablewright.functions import values
from tablewright.functions.dates import parse_date, to_ts
from tablewright.functions.naming import column_letter, norm_col, sheet_label, table_name, unused_name

TEXT = StringType()

NUMBERS = [
    ("5000", 5000.0), (" 12 ", 12.0), ("-500", -500.0), ("+3", 3.0), ("0.00001", 0.00001), (".5", 0.5), ("5.", 5.0),
    ("1e3", 1000.0), ("1E-2", 0.01), ("ABC", None), ("12A", None), ("12D", None), ("1f", None), ("0x1p3", None),
    ("inf", None), ("NaN", None), ("1,000", None), ("1_000", None), ("", None), ("  ", None), (None, None), ("--5", None),
]


def test_numbers_in_text(spark):
    df = spark.createDataFrame([(t,) for t, _ in NUMBERS], "x string")
    found = [r[0] for r in df.select(values.to_num(F.col("x"), TEXT)).collect()]
    assert found == [n for _, n in NUMBERS]
    assert [values.parse_number(t) for t, _ in NUMBERS] == [n for _, n in NUMBERS]


DATES = [
    ("2025-01-02", datetime(2025, 1, 2)), ("2025/01/05", datetime(2025, 1, 5)), ("01/31/2025", datetime(2025, 1, 31)),
    ("13/01/2025", datetime(2025, 1, 13)), ("01/02/2025", datetime(2025, 1, 2)), ("Jan 03 2025", datetime(2025, 1, 3)),
    ("Jan 3, 2025", datetime(2025, 1, 3)), ("04-Jan-2025", datetime(2025, 1, 4)), ("4 January 2025", datetime(2025, 1, 4)),
    ("2025-01-02 03:04", datetime(2025, 1, 2, 3, 4)), ("2025-01-02T03:04:05.25", datetime(2025, 1, 2, 3, 4, 5, 250000)),
    ("1/2/25", datetime(2025, 1, 2)), ("1/2/75", datetime(1975, 1, 2)), ("20250103", datetime(2025, 1, 3)),
    ("2025-03", datetime(2025, 3, 1)), ("March 2025", datetime(2025, 3, 1)), ("2025", datetime(2025, 1, 1)),
    ("01/02/2025 1:30 PM", datetime(2025, 1, 2, 13, 30)), ("01/02/2025 12:05 am", datetime(2025, 1, 2, 0, 5)),
    ("Fri, 3 Jan 2025", datetime(2025, 1, 3)), ("3rd Feb 2025", datetime(2025, 2, 3)), ("sept 9 2025", datetime(2025, 9, 9)),
    ("2025-02-30", None), ("2025-01-01 tail", None), ("notadate", None), ("", None), (None, None), ("Janus 3 2025", None),
    ("  2025-01-02  ", datetime(2025, 1, 2)), ("99/99/2025", None), ("5000", None),
    # A half of the day before a zone, and zones that can't be.
    ("01/01/2025 10:00 PM UTC", datetime(2025, 1, 1, 22)), ("2025-01-01 10:00 PM +05:30", datetime(2025, 1, 1, 16, 30)),
    ("Jan 1 2025 12:15 a.m. -0330", datetime(2025, 1, 1, 3, 45)), ("2025-01-01T22:00:01.1234567Z", datetime(2025, 1, 1, 22, 0, 1, 123456)),
    ("2025-01-01 10:00 +99:99", None), ("2025-01-01 10:00 +05:75", None), ("2025-01-01 25:00", None), ("2025-01-01 10:60", None),
    ("2025-01-01 10:00:60", None), ("2025-01-01\n10:00", datetime(2025, 1, 1, 10)), ("20250103 10:00", None), ("2025 10:00", None),
    ("31/12/99 11:59 pm", datetime(1999, 12, 31, 23, 59)), ("12/31/68", datetime(2068, 12, 31)), ("13/13/2025", None), ("0/1/2025", None),
    ("2025 march 4", datetime(2025, 3, 4)), ("2025-01-01 " + "x" * 200, None), ("1.2.2025", datetime(2025, 1, 2)), ("a\x01b jan", None),
]


def test_dates_in_text(spark):
    df = spark.createDataFrame([(t,) for t, _ in DATES], "x string")
    found = [r[0] for r in df.select(to_ts(F.col("x"), TEXT)).collect()]
    assert dict(zip([t for t, _ in DATES], found)) == dict(DATES)
    assert {t: parse_date(t) for t, _ in DATES} == dict(DATES)


def test_day_first_is_an_option(spark):
    df = spark.createDataFrame([("01/02/2025",), ("01/13/2025",)], "x string")
    found = [r[0] for r in df.select(to_ts(F.col("x"), TEXT, day_first=True)).collect()]
    assert found == [datetime(2025, 2, 1), datetime(2025, 1, 13)]
    assert parse_date("01/02/2025", day_first=True) == datetime(2025, 2, 1)


def test_white_space_is_what_python_calls_white_space(spark):
    import sys

    every = {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}
    assert set(values.WHITESPACE) == every
    df = spark.createDataFrame([(c + "a" + c,) for c in sorted(every)], "x string")
    assert {r[0] for r in df.select(values.trim_ws(F.col("x"))).collect()} == {"a"}
    assert {r[0] for r in df.select(F.regexp_replace("x", values.WHITESPACE_RUN, "")).collect()} == {"a"}


def test_blank(spark):
    df = spark.createDataFrame([("",), (" \t ",), (None,), ("x",), ("　",)], "x string")
    assert [r[0] for r in df.select(values.is_blank(F.col("x"), TEXT)).collect()] == [True, True, True, False, True]
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(values.is_blank(F.col("x"), DoubleType())).collect()] == [False, True, True]


def test_keys(spark):
    df = spark.createDataFrame([(" A@X.com ",), ("123",), (None,)], "x string")
    assert [r[0] for r in df.select(values.norm_key(F.col("x"), TEXT)).collect()] == ["a@x.com", "123", None]
    df = spark.createDataFrame([(123.0,), (1e7,), (1.5,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(values.norm_key(F.col("x"), DoubleType())).collect()] == ["123", "10000000", "1.5", None]
    df = spark.createDataFrame([(123,)], "x long")
    assert df.select(values.norm_key(F.col("x"), LongType())).first()[0] == "123"
    assert [values.norm_literal(v) for v in (123, 123.0, " AbC ", None, True)] == ["123", "123", "abc", None, "true"]


@pytest.mark.parametrize("position, letters", [(0, "A"), (2, "C"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")])
def test_column_letters(position, letters):
    assert column_letter(position) == letters


def test_names():
    assert {norm_col(n) for n in ("Customer ID", "customer_id", "CustomerID")} == {"customerid"}
    assert norm_col("नाम") == ""
    assert table_name("C:\\data\\Sales Jan.xlsx") == "Sales Jan"
    assert unused_name("a", {"a", "a (2)"}) == "a (3)"
    assert sheet_label("a:b/c" + "x" * 40, {}) == ("a b c" + "x" * 40)[:28]
    assert sheet_label("s", {"s"}) == "s 2"


def test_a_number_is_taken_apart_once(spark):
    df = spark.createDataFrame([(x,) for x in (1.5e-7, -1.5e-7, 1e20, -2.5e12, 1234567890.5, 12.0, 1e7)], "x double")
    shown = df.select(values.number_text(F.col("x"), DoubleType()).alias("t"))
    assert [r[0] for r in shown.collect()] == ["0.00000015", "-0.00000015", "1" + "0" * 20, "-2500000000000", "1234567890.5", "12", "10000000"]
    plan = shown._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 0 and plan.count("substring_index(") == 2

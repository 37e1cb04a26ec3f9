import math
import time
from datetime import datetime

import pytest

from tablewright import OperationError, add_formula_column, visible


@pytest.fixture
def value(rows):
    def compute(df, formula, **options):
        return rows(add_formula_column(df, "out", formula, **options), "out")

    return compute


def test_arithmetic(table, value):
    df = table("Qty long, Price long", [(2, 10), (3, 10)])
    assert value(df, "{Qty} * {Price}") == [20, 30]
    assert value(df, "({Qty} + {Price}) / 2 - 1") == [5.0, 5.5]
    assert value(df, "-{Qty} + +{Price}") == [8, 7]
    assert value(table("a string, b string", [("10", "1"), ("20", "2"), ("", "3")]), "{a} + {b}") == [11, 22, None]
    assert value(df, "7") == [7, 7]


def test_division_by_zero(table, value):
    df = table("a double, b double", [(10.0, 2.0), (5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (None, 0.0)])
    found = value(df, "{a} / {b}")
    assert found[:3] == [5.0, math.inf, -math.inf] and math.isnan(found[3]) and found[4] is None
    assert value(df, "{a} / {b}", div_zero="null") == [5.0, None, None, None, None]


def test_modulo_takes_the_sign_of_the_divisor(table, value):
    df = table("a long, b long", [(7, 3), (-7, 3), (7, -3), (-7, -3)])
    assert value(df, "{a} % {b}") == [1, 2, -2, -1]
    assert math.isnan(value(table("a long", [5]), "{a} % 0")[0])


def test_power(table, value):
    df = table("a double, n double", [(2.0, 3.0), (9.0, 0.5), (1e300, 2.0), (-8.0, 0.5)])
    found = value(df, "{a} ** {n}")
    assert found[:3] == [8.0, 3.0, math.inf] and math.isnan(found[3])
    for formula in ("2 ** 100000", "{a} ** {a}", "2 ** -101", "2 ** (10 * 11)", "2 ** ({n} * 50)"):
        with pytest.raises(OperationError, match="Powers"):
            value(df, formula)


def test_functions(table, value):
    df = table("a long, b long, c long", [(1, 2, 6), (4, None, 0), (-3, 5, 1)])
    assert value(df, "SUM({a}, {b}, {c})") == [9, None, 3]
    assert value(df, "AVERAGE({a}, {b}, {c})") == [3, None, 1]
    assert value(df, "avg({a}, {c})") == value(df, "Mean({a}, {c})") == [3.5, 2, -1]
    assert value(df, "MIN({a}, {b}, {c})") == [1, None, -3]
    assert value(df, "MAX({a}, {b}, {c})") == [6, None, 5]
    assert value(df, "ABS({a})") == [1, 4, 3]
    assert value(df, "INT({a} / 2)") == [0, 2, -2]
    assert value(df, "ROUND(10 / 3, 2)") == [3.33] * 3
    assert value(df, "SQRT({c})")[0] == math.sqrt(6) and math.isnan(value(df, "SQRT({a})")[2])
    halves = table("x double", [0.5, 1.5, 2.5, -2.5, 2.675, 1e18])
    assert value(halves, "ROUND({x})") == [0, 2, 2, -2, 3, 1e18]
    assert value(halves, "ROUND({x}, 2)")[4] == 2.67 or value(halves, "ROUND({x}, 2)")[4] == 2.68
    assert value(table("x double", [1234.0]), "ROUND({x}, -2)") == [1200]
    assert value(halves, "INT({x})")[5] == 1e18


def test_rounding_is_numpys(table, value):
    import numpy as np

    numbers = [2.675, 1.005, 0.125, 0.375, 1e-7, 123456.785, -0.5, -1.125]
    df = table("x double", numbers)
    for digits in (0, 1, 2, 3):
        assert value(df, f"ROUND({{x}}, {digits})") == np.round(numbers, digits).tolist()


def test_if(table, value):
    df = table("Revenue long, Cost long", [(10000, 5000), (12000, 6000), (15000, 9000)])
    nested = 'IF(({Revenue} - {Cost}) / {Revenue} >= 0.5, IF({Revenue} > 11000, "B", "C"), "A")'
    assert value(df, nested) == ["C", "B", "A"]
    assert value(df, 'IF({Revenue} > 11000, "big")') == [None, "big", "big"]
    assert value(df, 'IF({Cost} = 6000, {Revenue}, "other")') == ["other", "12000", "other"]
    assert value(df, 'IF({Cost} <> 6000 and {Revenue} > 10000, 1, 0)') == [0, 0, 1]
    assert value(df, 'IF({Cost} > 8000 or {Revenue} == 10000, 1, 0)') == [1, 0, 1]
    assert value(df, "IF({Cost} - 5000, 1, 0)") == [0, 1, 1]


def test_comparisons_of_missing_cells(table, value):
    df = table("a long, t string", [(1, "x"), (None, None), (3, "X")])
    assert value(df, "{a} > 0") == [True, False, True]
    assert value(df, "{a} <> 1") == [False, True, True]
    assert value(df, '{t} = "x"') == [True, False, False]
    assert value(df, '{t} != "x"') == [False, True, True]
    assert value(df, '{a} = "x"') == [False, False, False]
    assert value(df, "({a} / 0) * 0 > 1") == [False, False, False]


def test_text_in_quotes_is_left_alone(table, value):
    df = table("t string", ["a=b", "c"])
    assert value(df, "IF({t} = 'a=b', '<>', \"{x}\")") == ["<>", "{x}"]


def test_dates_compare_with_written_dates(table, value):
    df = table("d timestamp_ntz", [datetime(2025, 1, 1), datetime(2025, 6, 1), None])
    assert value(df, 'IF({d} >= "2025-02-01", 1, 0)') == [0, 1, 0]
    with pytest.raises(OperationError):
        value(df, "{d} + 1")


def test_target_column(table, rows):
    df = table("a long, b long", [(1, 2)])
    assert visible(add_formula_column(df, " c ", "{a}")).columns == ["a", "b", "c"]
    with pytest.raises(OperationError, match="already"):
        add_formula_column(df, "b", "{a}")
    assert rows(add_formula_column(df, "b", "{a} + 5", overwrite=True)) == [(1, 6)]
    assert visible(add_formula_column(df, "B", "{a}")).columns == ["a", "b", "B"]


def test_awkward_column_names(table, value):
    assert value(table("`Roll No.` long, `Qty` long", [(2, 3)]), "{Roll No.} * {Qty}") == [6]


HOSTILE = [
    "__import__('os').system('true')", "{a}.__class__", "open('x')", "lambda: 1", "[1 for x in {a}]", "{a}[0]", "a",
    "{a} if {a} else 0", "not {a}", "{a} < {a} < {a}", "MEDIAN({a})", "AND({a} > 1, {a} < 2)", "ROUND({a}, {a})", "IF({a})",
    "{a} +", "(", "{a} // 2", "{a} & 1", "SUM()", "SUM(x={a})", "1j", "b'x'", "f'{a}'", "-" * 1990 + "1 +", "+" * 1000 + "(" * 900,
]


@pytest.mark.parametrize("formula", HOSTILE)
def test_refused(table, formula):
    with pytest.raises(OperationError):
        add_formula_column(table("a long", [1]), "out", formula)


def test_refusals_are_quick_and_named(table):
    df = table("a long, Name string", [(1, "x")])
    begin = time.time()
    with pytest.raises(OperationError, match="characters"):
        add_formula_column(df, "out", "1+" * 5000 + "1")
    with pytest.raises(OperationError, match="Powers"):
        add_formula_column(df, "out", "9 ** 9 ** 9")
    assert time.time() - begin < 1
    for formula, word in [("{Name} * 2", "Name"), ("IF({a} > 0, {Name} + 1, 0)", "text"), ("{Nope} + 1", "Nope"), ("", "formula")]:
        with pytest.raises(OperationError, match=word):
            add_formula_column(df, "out", formula)
    with pytest.raises(OperationError, match="name"):
        add_formula_column(df, " ", "{a}")


def test_stays_in_generated_code(table):
    plan = add_formula_column(table("a long", [1]), "out", "IF({a} > 0, ROUND({a} / 3, 2), SQRT({a} % 7))")
    assert "Python" not in plan._jdf.queryExecution().toString()


BIG = 9007199254740993  # 2 ** 53 + 1


def test_whole_numbers_stay_exact_beyond_doubles(table, value):
    df = table("a long, b int", [(BIG, 3), (-BIG, 7), (None, 1), (2**62, 0)])
    assert value(df, "{a} % 10") == [BIG % 10, -BIG % 10, None, 2**62 % 10]
    assert value(df, "{a} % -10") == [BIG % -10, -BIG % -10, None, 2**62 % -10]
    assert value(df, "INT({a})") == [BIG, -BIG, None, 2**62]
    assert value(df, "ROUND({a})") == [BIG, -BIG, None, 2**62]
    assert value(df, "ROUND({a}, 2)") == [BIG, -BIG, None, 2**62]
    assert value(table("a long", [25, 35, -25, BIG]), "ROUND({a}, -1)") == [20, 40, -20, BIG - 3]
    assert value(table("a long", [BIG]), "ROUND({a}, -30)") == [0]
    assert value(table("x double", [1e300, 1.25]), "ROUND({x}, 20)") == [1e300, 1.25]


def test_whole_results_that_outgrow_64_bits_are_decimals(table, value):
    df = table("a long, b int", [(2**62, 5), (-(2**62), 3), (None, 1)])
    assert value(df, "{a} * {b}") == [5 * 2**62, -3 * 2**62, None]
    assert value(df, "{a} + {a} + 1") == [2**63 + 1, -(2**63) + 1, None]
    assert value(df, "SUM({a}, {a}, {b}) % 7") == [(2**63 + 5) % 7, (-(2**63) + 3) % 7, None]
    assert value(df, "IF({b} > 3, {a} * {a}, {a} - 1)") == [2**124, -(2**62) - 1, None]
    out = add_formula_column(df, "out", "{a} + {b}")
    assert dict(out.dtypes)["out"] == "bigint"  # nothing outgrows it
    assert dict(add_formula_column(df, "out", "{a} * {b}").dtypes)["out"] == "decimal(38,0)"
    assert dict(add_formula_column(df, "out", "{b} * {b}").dtypes)["out"] == "bigint"

"""Per-row formulas."""

from tablewright import add_formula_column, select_columns
from workload.base import register, source

_LINE = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax"
_NULLABLE = "c_custkey, c_acctbal, level"
_LEVEL = "cast(level as double)"

# name -> (table, columns, formula, SQL of the same meaning)
_FORMULAS = {
    "formula_arithmetic": ("lineitem", _LINE, "{l_extendedprice} * (1 - {l_discount}) * (1 + {l_tax})",
                           "l_extendedprice * (1 - l_discount) * (1 + l_tax)"),
    "formula_nested_if": ("lineitem", _LINE, 'IF({l_quantity} >= 40, "bulk", IF({l_quantity} > 10, "some", "few"))',
                          "case when l_quantity >= 40 then 'bulk' when l_quantity > 10 then 'some' else 'few' end"),
    "formula_if_without_else": ("lineitem", _LINE, "IF({l_discount} = 0 and {l_tax} <> 0, {l_extendedprice})",
                                "case when l_discount = 0 and l_tax <> 0 then l_extendedprice end"),
    "formula_division_by_zero": ("lineitem", _LINE, "{l_extendedprice} / {l_discount}",
                                 "case when l_discount = 0 then 'inf'::double else l_extendedprice / l_discount end"),
    "formula_modulo": ("lineitem", _LINE, "({l_quantity} - 25) % -7",
                       "(l_quantity - 25) - (-7) * floor((l_quantity - 25) / (-7))"),
    "formula_power": ("part", "p_partkey, p_size", "{p_size} ** 2 + 2 ** 10", "cast(p_size as double) ** 2 + 1024"),
    "formula_round": ("lineitem", _LINE, "ROUND({l_quantity} / 8, 2)", "round_even(l_quantity / 8 * 100, 0) / 100"),
    "formula_abs_int_sqrt": ("customer", "c_custkey, c_acctbal", "INT({c_acctbal} / 7) + ABS({c_acctbal}) + SQRT(ABS({c_acctbal}))",
                             "floor(c_acctbal / 7) + abs(c_acctbal) + sqrt(abs(c_acctbal))"),
    "formula_row_sum": ("messy_customer", _NULLABLE, "SUM({c_acctbal}, {level}, 1)", f"c_acctbal + {_LEVEL} + 1"),
    "formula_row_average": ("messy_customer", _NULLABLE, "AVERAGE({c_acctbal}, {level})", f"(c_acctbal + {_LEVEL}) / 2"),
    "formula_row_min": ("messy_customer", _NULLABLE, "MIN({c_acctbal}, {level})",
                        f"case when c_acctbal is not null and level is not null then least(c_acctbal, {_LEVEL}) end"),
    "formula_row_max": ("messy_customer", _NULLABLE, "MAX({c_acctbal}, {level}, 100)",
                        f"case when c_acctbal is not null and level is not null then greatest(c_acctbal, {_LEVEL}, 100) end"),
    "formula_comparison": ("messy_customer", _NULLABLE, "{c_acctbal} <> 100 or {level} > 50",
                           f"coalesce(c_acctbal <> 100, true) or coalesce({_LEVEL} > 50, false)"),
    "formula_text_comparison": ("messy_customer", "c_custkey, segment", 'IF({segment} == "BUILDING", 1, 0)',
                                "case when segment = 'BUILDING' then 1.0::double else 0.0::double end"),
    "formula_mixed_branches": ("part", "p_partkey, p_size", 'IF({p_size} > 25, {p_size}, "small")',
                               "case when p_size > 25 then cast(p_size as string) else 'small' end"),
    "formula_date_comparison": ("orders", "o_orderkey, o_orderdate", 'IF({o_orderdate} < "Jan 1 1998", "old", "new")',
                                "case when o_orderdate < timestamp '1998-01-01' then 'old' else 'new' end"),
}

for _name, (_table, _columns, _formula, _sql) in _FORMULAS.items():
    register(
        _name,
        lambda spark, sf, t=_table, c=_columns, f=_formula: add_formula_column(
            select_columns(source(spark, sf, t), c.split(", ")), "result", f
        ),
        f"select {_columns}, {_sql} as result from {_table}",
    )

register(
    "formula_whole_numbers",
    lambda spark, sf: add_formula_column(
        source(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey + 9007199254740992 as big"),
        "result", "SUM({big}, {l_linenumber}, 1) - 2 * {l_linenumber}",
    ),
    "select *, big + l_linenumber + 1 - 2 * l_linenumber as result from (select l_orderkey, l_linenumber, l_orderkey + 9007199254740992 as big from lineitem)",
)

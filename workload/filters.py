"""Every predicate, over messy text, typed columns, and both ways of joining conditions."""

from tablewright import Condition, filter_rows
from workload.base import PLACED, POINTS, query, register, source

_SEGMENT = "lower(trim(segment))"
_PREDICATES = {
    "filter_equals": ("messy_customer", Condition("segment", "equals", "Building "), f"{_SEGMENT} = 'building'"),
    "filter_not_equals": ("messy_customer", Condition("segment", "not_equals", "BUILDING"), f"coalesce({_SEGMENT} <> 'building', true)"),
    "filter_in": ("messy_customer", Condition("segment", "in", values=["building", " Machinery"]), f"{_SEGMENT} in ('building', 'machinery')"),
    "filter_not_in": ("messy_customer", Condition("segment", "not_in", values=["building", "machinery"]),
                      f"coalesce({_SEGMENT} not in ('building', 'machinery'), true)"),
    "filter_contains": ("messy_customer", Condition("segment", "contains", "ILD"), "contains(lower(segment), 'ild')"),
    "filter_starts_with": ("messy_customer", Condition("segment", "starts_with", "mach"), "starts_with(lower(segment), 'mach')"),
    "filter_ends_with": ("messy_customer", Condition("segment", "ends_with", "URE"), "ends_with(lower(segment), 'ure')"),
    "filter_is_blank": ("messy_customer", Condition("segment", "is_blank"), "segment is null or trim(segment) = ''"),
    "filter_not_blank": ("messy_customer", Condition("segment", "not_blank"), "segment is not null and trim(segment) <> ''"),
    "filter_greater_than": ("orders", Condition("o_totalprice", "greater_than", "250000"), "o_totalprice > 250000"),
    "filter_less_than": ("orders", Condition("o_totalprice", "less_than", "1500.5"), "o_totalprice < 1500.5"),
    "filter_greater_or_equal": ("orders", Condition("o_custkey", "greater_or_equal", "700"), "o_custkey >= 700"),
    "filter_less_or_equal": ("orders", Condition("o_custkey", "less_or_equal", 99.5), "o_custkey <= 99.5"),
    "filter_between_swapped": ("lineitem", Condition("l_quantity", "between", "20", "10"), "l_quantity between 10 and 20"),
    "filter_equals_number": ("orders", Condition("o_custkey", "equals", " 77 "), "o_custkey = 77"),
    "filter_in_numbers": ("part", Condition("p_size", "in", values=["1", "7", "x"]), "p_size in (1, 7)"),
    "filter_numbers_in_text": ("messy_customer", Condition("points", "greater_than", "500"), f"{POINTS} > 500"),
    "filter_date_column": ("orders", Condition("o_orderdate", "between", "01/01/1996", "Dec 31 1996"),
                           "o_orderdate between timestamp '1996-01-01' and timestamp '1996-12-31'"),
    "filter_equals_date": ("orders", Condition("o_orderdate", "equals", "1996-01-02"), "o_orderdate = timestamp '1996-01-02'"),
    "filter_dates_in_text": ("messy_orders", Condition("placed", "less_than", "1997-03-04"), f"{PLACED} < timestamp '1997-03-04'"),
    "filter_text_of_documents": ("documents", Condition("text", "contains", "The "), "contains(lower(text), 'the ')"),
}

for _name, (_table, _condition, _where) in _PREDICATES.items():
    register(
        _name,
        lambda spark, sf, t=_table, c=_condition: filter_rows(source(spark, sf, t), [c]),
        f"select * from {_table} where {_where}",
    )

_DEAR = Condition("o_totalprice", "greater_than", 300000)
_URGENT = {"column": "o_orderpriority", "operator": "starts_with", "value": "1"}


@query("select * from orders where o_totalprice > 300000 and starts_with(o_orderpriority, '1')")
def filter_and(spark, sf):
    return filter_rows(source(spark, sf, "orders"), [_DEAR, _URGENT])


@query("select * from orders where o_totalprice > 300000 or starts_with(o_orderpriority, '1')")
def filter_or(spark, sf):
    return filter_rows(source(spark, sf, "orders"), [_DEAR, _URGENT], combine="or")

"""Per-row formulas with ``{Column}`` placeholders, translated once into a Catalyst expression.

The text is read with Python's own expression grammar and only the listed node types are translated, so a
formula can name columns and compute; it cannot call, import or look up anything else. Nothing is ever
evaluated on the driver but constants.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tablewright.errors import OperationError
from tablewright.functions.dates import date_literal, parse_date
from tablewright.functions.values import number_text

# Limits of a formula and the names of its row-wise functions.
MAX_LENGTH = 2000
MAX_EXPONENT = 100
FUNCTIONS = ("IF", "ABS", "SQRT", "INT", "ROUND", "SUM", "AVERAGE", "AVG", "MEAN", "MIN", "MAX")

_TOKEN = re.compile(r"""(?P<text>"[^"]*"|'[^']*')|\{(?P<column>[^{}]+)\}|(?P<unequal><>)|(?P<kept>[<>!=]=)|(?P<equal>=)""")


def placeholders(formula: str) -> list[str]:
    """The columns a formula names, in order of first use."""
    return list(dict.fromkeys(t["column"] for t in _TOKEN.finditer(formula) if t["column"]))


def is_plain(formula: str) -> bool:
    """Arithmetic only: no function call and no comparison."""
    return not re.search(r"[A-Za-z_]\w*\s*\(|[<>=]", formula)


@dataclass(frozen=True)
class Term:
    """A translated part of a formula. ``kind`` is number, text, bool, date or null.

    ``whole`` is the same number as an exact bigint (or, translated with ``wide``, decimal) where all that it is made of is whole;
    ``counted`` tells that a column is part of it, as numbers alone stay doubles.
    """

    column: Column
    kind: str
    constant: object = None
    maybe_nan: bool = False
    whole: Column | None = None
    counted: bool = False


@dataclass
class Formula:
    """A translated formula. ``exponents`` are column-dependent powers whose size must be checked on the data; ``grows`` tells that
    whole numbers are added or multiplied, so that the result may need more than 64 bits."""

    term: Term | None = None
    exponents: list[Column] = field(default_factory=list)
    grows: bool = False

    @property
    def is_whole(self) -> bool:
        return self.term.whole is not None and self.term.counted

    @property
    def column(self) -> Column:
        """The value; whole numbers stay whole, and one that outgrows its type is NULL."""
        return self.term.whole if self.is_whole else self.term.column


def _double(value: float) -> Column:
    return F.lit(float(value))


def _ieee_divide(a: Column, b: Column) -> Column:
    """Division that never fails: x/0 is an infinity with the sign of x, 0/0 is NaN."""
    by_zero = (
        F.when(a > 0, _double("inf")).when(a < 0, _double("-inf")).when(a.isNotNull(), _double("nan"))
    )
    return F.when(b == 0, by_zero).otherwise(a / b)


def _floor_modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NaN for a zero divisor."""
    return F.when(b == 0, F.when(a.isNotNull(), _double("nan"))).otherwise(a - b * F.floor(a / b).cast("double"))


def _whole_modulo(a: Column, b: Column) -> Column:
    """Remainder of whole numbers with the sign of the divisor, which is not zero."""
    rest = a % b
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def _any_null(columns: list[Column]) -> Column:
    return reduce(operator.or_, [c.isNull() | F.isnan(c) for c in columns])


def _round_half_even(c: Column, digits: int) -> Column:
    scale = _double(10.0 ** abs(digits))
    if digits < 0:
        return F.rint(c / scale) * scale
    scaled = c * scale
    # A number too large to be scaled has no such digits to round.
    return F.when(F.abs(scaled) < float("inf"), F.rint(scaled) / scale).otherwise(c)


def _whole_round(c: Column, digits: int) -> Column:
    """Whole numbers rounded to tens, hundreds, ..., halves to the even side."""
    if digits >= 0:
        return c
    if digits < -18:
        return F.when(c.isNotNull(), F.lit(0)).cast("bigint")
    return F.bround(c.cast("decimal(38,0)"), digits).try_cast("decimal(38,0)")


_ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: _ieee_divide,
    ast.Mod: _floor_modulo,
    ast.Pow: F.pow,
}
_WHOLE = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}
_COMPARISON: dict[type, Callable] = {
    ast.Gt: operator.gt,
    ast.Lt: operator.lt,
    ast.GtE: operator.ge,
    ast.LtE: operator.le,
    ast.Eq: operator.eq,
    ast.NotEq: operator.ne,
}


def _wholes(terms: list[Term]) -> list[Column] | None:
    found = [t.whole for t in terms if t.whole is not None]
    return found if len(found) == len(terms) else None


class _Translator(ast.NodeVisitor):
    def __init__(self, names: Mapping[str, Term], wide: bool = False):
        self.names = names
        self.exponents: list[Column] = []
        self.wide = wide
        self.grows = False

    def _int(self, value: int) -> Column:
        return F.lit(value).cast("decimal(38,0)" if self.wide else "bigint")

    def generic_visit(self, node):
        raise OperationError("The formula uses something that is not supported.")

    def visit_Constant(self, node) -> Term:
        value = node.value
        if value is None:
            return Term(F.lit(None), "null")
        if isinstance(value, bool):
            return Term(F.lit(value), "bool", value)
        if isinstance(value, (int, float)):
            return self._number(float(value), value)
        if isinstance(value, str):
            return Term(F.lit(value), "text", value)
        return self.generic_visit(node)

    def _number(self, value: float, shown=None) -> Term:
        whole = self._int(shown) if isinstance(shown, int) and abs(shown) < 2**63 else None
        return Term(_double(value), "number", value if shown is None else shown, whole=whole)

    def visit_Name(self, node) -> Term:
        if node.id not in self.names:
            raise OperationError(f"Unknown name in the formula: {node.id!r}.")
        return self.names[node.id]

    def _numeric(self, term: Term) -> Term:
        if term.kind == "number":
            return term
        if term.kind == "bool":
            return Term(term.column.cast("double"), "number")
        if term.kind == "null":
            return Term(F.lit(None).cast("double"), "number")
        raise OperationError(f"Arithmetic needs numbers, and one part of the formula is {term.kind}.")

    def visit_UnaryOp(self, node) -> Term:
        inner = self._numeric(self.visit(node.operand))
        if isinstance(node.op, ast.UAdd):
            return inner
        if isinstance(node.op, ast.USub):
            constant = -inner.constant if inner.constant is not None else None
            whole = F.try_subtract(self._int(0), inner.whole) if inner.whole is not None else None
            return replace(inner, column=-inner.column, constant=constant, whole=whole)
        return self.generic_visit(node)

    def visit_BinOp(self, node) -> Term:
        build = _ARITHMETIC.get(type(node.op))
        if build is None:
            return self.generic_visit(node)
        left, right = self._numeric(self.visit(node.left)), self._numeric(self.visit(node.right))
        if isinstance(node.op, ast.Pow):
            self._check_exponent(right)
        constant = None
        if left.constant is not None and right.constant is not None and not isinstance(node.op, ast.Pow):
            try:
                python = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv,
                          ast.Mod: operator.mod}[type(node.op)]
                constant = python(float(left.constant), float(right.constant))
            except ArithmeticError:
                constant = None
        risky = isinstance(node.op, (ast.Div, ast.Mod, ast.Pow)) or left.maybe_nan or right.maybe_nan
        exact, wholes = _WHOLE.get(type(node.op)), _wholes([left, right])
        whole = self._fit(exact(*wholes)) if exact and wholes else None
        self.grows |= whole is not None and (left.counted or right.counted)
        if isinstance(node.op, ast.Mod) and wholes and right.constant:
            whole = self._fit(_whole_modulo(*wholes))
            return Term(whole.cast("double"), "number", constant, left.maybe_nan, whole, left.counted)
        return Term(build(left.column, right.column), "number", constant, risky, whole, left.counted or right.counted)

    def _fit(self, whole: Column) -> Column:
        """A whole number in the type that whole numbers have here."""
        return whole.cast("decimal(38,0)") if self.wide else whole

    def _check_exponent(self, exponent: Term) -> None:
        if exponent.constant is None:
            self.exponents.append(exponent.column)
        elif abs(exponent.constant) > MAX_EXPONENT:
            raise OperationError(f"Powers above {MAX_EXPONENT} are not supported.")

    def visit_Compare(self, node) -> Term:
        if len(node.ops) != 1 or type(node.ops[0]) not in _COMPARISON:
            raise OperationError("Compare two things at a time, with > < >= <= = or <>.")
        compare = _COMPARISON[type(node.ops[0])]
        unequal, equality = isinstance(node.ops[0], ast.NotEq), isinstance(node.ops[0], (ast.Eq, ast.NotEq))
        left, right = self._alike(self.visit(node.left), self.visit(node.comparators[0]))
        if left.kind != right.kind or left.kind == "null":
            if not equality and "null" not in (left.kind, right.kind):
                raise OperationError(f"A {left.kind} can't be ordered against a {right.kind}.")
            return Term(F.lit(unequal), "bool")
        found = compare(self._real(left), self._real(right))
        return Term(F.coalesce(found, F.lit(unequal)), "bool")

    @staticmethod
    def _real(term: Term) -> Column:
        return F.when(~F.isnan(term.column), term.column) if term.maybe_nan else term.column

    def _alike(self, left: Term, right: Term) -> tuple[Term, Term]:
        kinds = {left.kind, right.kind}
        if kinds == {"number", "bool"}:
            return self._numeric(left), self._numeric(right)
        if kinds == {"date", "text"}:
            return self._as_date(left), self._as_date(right)
        return left, right

    @staticmethod
    def _as_date(term: Term) -> Term:
        moment = parse_date(term.constant) if term.kind == "text" else None
        return Term(date_literal(moment), "date") if moment else term

    def visit_BoolOp(self, node) -> Term:
        parts = [self.visit(v) for v in node.values]
        if any(p.kind != "bool" for p in parts):
            raise OperationError("'and' and 'or' join comparisons.")
        join = operator.and_ if isinstance(node.op, ast.And) else operator.or_
        return Term(reduce(join, [p.column for p in parts]), "bool")

    def visit_Call(self, node) -> Term:
        name = node.func.id.upper() if isinstance(node.func, ast.Name) else ""
        if name not in FUNCTIONS or node.keywords:
            shown = node.func.id if isinstance(node.func, ast.Name) else "this call"
            raise OperationError(f"The function {shown} is not supported.")
        if not node.args:
            raise OperationError(f"{name} needs arguments.")
        args = [self.visit(a) for a in node.args]
        if name == "IF":
            return self._if(args)
        numbers = [self._numeric(a) for a in args]
        columns = [n.column for n in numbers]
        risky = any(n.maybe_nan for n in numbers)
        first = columns[0]
        wholes, counted = _wholes(numbers), any(n.counted for n in numbers)
        if name in ("ABS", "SQRT", "INT") and len(args) > 1:
            raise OperationError(f"{name} takes one argument.")
        if name == "ABS":
            whole = F.when(wholes[0] < 0, F.try_subtract(self._int(0), wholes[0])).otherwise(wholes[0]) if wholes else None
            return Term(F.abs(first), "number", maybe_nan=risky, whole=whole, counted=counted)
        if name == "SQRT":
            return Term(F.sqrt(first), "number", maybe_nan=True)
        if name == "INT":
            small = F.abs(first) < 2.0**52  # larger doubles have no fraction; floor() would not fit them
            value = F.when(small, F.floor(first).cast("double")).otherwise(first)
            return Term(value, "number", maybe_nan=risky, whole=wholes[0] if wholes else None, counted=counted)
        if name == "ROUND":
            digits = args[1].constant if len(args) > 1 else 0
            if isinstance(digits, bool) or not isinstance(digits, (int, float)) or abs(digits) > 300:
                raise OperationError("ROUND takes a plain number of digits.")
            exact = _wholes(numbers[:1])
            whole = _whole_round(exact[0], int(digits)) if exact else None
            if whole is not None and not self.wide:
                whole = whole.try_cast("bigint")
            return Term(_round_half_even(first, int(digits)), "number", maybe_nan=risky, whole=whole, counted=numbers[0].counted)
        if name in ("MIN", "MAX"):
            pick = F.least if name == "MIN" else F.greatest
            value = pick(*columns) if len(columns) > 1 else first
            exact = (pick(*wholes) if len(wholes) > 1 else wholes[0]) if wholes else None
            whole = F.when(~_any_null(columns), exact) if wholes else None
            return Term(F.when(~_any_null(columns), value), "number", whole=whole, counted=counted)
        total = reduce(operator.add, columns)
        if name == "SUM":
            self.grows |= bool(wholes) and counted
            whole = reduce(lambda a, b: self._fit(F.try_add(a, b)), wholes) if wholes else None
            return Term(total, "number", maybe_nan=risky, whole=whole, counted=counted)
        return Term(total / _double(len(columns)), "number", maybe_nan=risky)

    def _if(self, args: list[Term]) -> Term:
        if len(args) not in (2, 3):
            raise OperationError("IF takes a condition, a value and an optional other value.")
        test, then = args[0], args[1]
        other = args[2] if len(args) == 3 else Term(F.lit(None), "null")
        if test.kind == "number":
            condition = test.column != 0
        elif test.kind == "bool":
            condition = test.column
        else:
            raise OperationError("IF needs a comparison as its condition.")
        kinds = {then.kind, other.kind} - {"null"}
        kind = kinds.pop() if len(kinds) == 1 else "text" if kinds else "null"
        if kind == "text":
            then, other = self._as_text(then), self._as_text(other)
        met = F.coalesce(condition, F.lit(False))
        column = F.when(met, then.column).otherwise(other.column)
        branches = [t for t in (then, other) if t.kind != "null"]
        whole = F.when(met, then.whole).otherwise(other.whole) if kind == "number" and len(branches) == 2 and _wholes(branches) else None
        return Term(column, kind, maybe_nan=then.maybe_nan or other.maybe_nan, whole=whole, counted=all(b.counted for b in branches))

    @staticmethod
    def _as_text(term: Term) -> Term:
        if term.kind in ("text", "null"):
            return Term(term.column.cast("string"), "text")
        if term.kind == "number":
            shown = F.lit(str(term.constant)) if isinstance(term.constant, int) else number_text(term.column, DoubleType())
            return Term(shown, "text")
        return Term(term.column.cast("string"), "text")


def translate(formula: str, resolve: Callable[[str], Term], wide: bool = False) -> Formula:
    """Translate ``formula``; ``resolve`` gives the term of each column it names. With ``wide`` whole numbers have 38 digits."""
    if len(formula) > MAX_LENGTH:
        raise OperationError(f"A formula may have at most {MAX_LENGTH} characters.")
    names: dict[str, Term] = {}
    idents: dict[str, str] = {}

    def spell(found: re.Match) -> str:
        if found["column"]:
            ident = idents.setdefault(found["column"], f"tw_column_{len(idents)}")
            if ident not in names:
                names[ident] = resolve(found["column"])
            return f" {ident} "
        if found["unequal"]:
            return "!="
        return "==" if found["equal"] else found[0]

    python = _TOKEN.sub(spell, formula).strip()
    translator = _Translator(names, wide)
    try:
        term = translator.visit(ast.parse(python, mode="eval").body)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        if isinstance(problem, OperationError):
            raise
        raise OperationError(f"The formula {formula[:80]!r} can't be read.") from None
    return Formula(term, translator.exponents, translator.grows)


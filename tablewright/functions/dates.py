"""Mixed-format dates: one column may hold 01/31/2025, 2025-01-31, Jan 31 2025 and 31-Jan-2025.

One expression that lists the accepted shapes takes a cell apart into tokens: those of its date, whichever shape it has, and those of its
clock (hour, minute, second, fraction, half of the day, zone). So a cell is read once however many shapes there are, and the tokens
decide what the moment is. Impossible dates, times and zones and trailing text give NULL. The same expression reads the
dates that callers give as literals.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tablewright.functions.values import is_temporal, is_text, once, trim_ws

# The accepted date shapes. Two-digit years turn at 69, as in POSIX.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAME = (
    "(" + "|".join(MONTHS) + ")"
    r"(?:(?<=jan)uary|(?<=feb)ruary|(?<=mar)ch|(?<=apr)il|(?<=jun)e|(?<=jul)y|(?<=aug)ust|(?<=sep)t(?:ember)?|"
    r"(?<=oct)ober|(?<=nov)ember|(?<=dec)ember)?\.?"
)
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_TURN_OF_CENTURY = 69
#: The longest text that is looked at.
_LONGEST = 100

#: Hour, minute, second, fraction (six digits are kept), half of the day, zone.
_CLOCK = (
    r"(?:(?:\s+|t)(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6})\d{0,3})?)?"
    r"(?:\s*([ap])\.?m\.?)?(?:\s*(z|utc|gmt|[+-](?:[01]\d|2[0-3]):?[0-5]\d))?)?"
)
#: Each shape with the tokens its groups give: y(ear), m(onth), d(ay), p and q (month and day in either order, before a year x of two
#: or four digits), n(ame of the month).
_BEFORE_CLOCK = (
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "ymd"),
    (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})", "pqx"),
    (_WEEKDAY + _NAME + r"[\s/-]*" + _DAY + r"(?:,\s*|[\s/-]+)(\d{4})", "ndy"),
    (_WEEKDAY + _DAY + r"[\s/-]*" + _NAME + r"(?:,\s*|[\s/-]+)(\d{4})", "dny"),
    (r"(\d{4})[\s/-]+" + _NAME + r"[\s/-]+" + _DAY, "ynd"),
)
_ALONE = (
    (r"(\d{4})(\d{2})(\d{2})", "ymd"),
    (r"(\d{4})-(\d{1,2})", "ym"),
    (r"((?:1[7-9]|2[01])\d{2})", "y"),
    (_NAME + r"[\s,-]+(\d{4})", "ny"),
)
_MOMENT = f"(?i)^(?:(?:{'|'.join(p for p, _ in _BEFORE_CLOCK)}){_CLOCK}|{'|'.join(p for p, _ in _ALONE)})$"
#: What each group of the expression gives; capitals are tokens of the clock.
_GROUPS = "".join(t for _, t in _BEFORE_CLOCK) + "HMSFAZ" + "".join(t for _, t in _ALONE)
_TOKENS = "ymdpqxnHMSFAZ"
_BREAK = "\x01"  # stands between tokens
# At most one of a token's groups takes part in a match; the others are empty.
_TO_TOKENS = _BREAK.join("".join(f"${i}" for i, g in enumerate(_GROUPS, 1) if g == t) for t in _TOKENS)


def _date_text(at: dict[str, Column], day_first: bool) -> Column:
    """year-month-day of the tokens; NULL where month and day can't be told."""
    p, q = at["p"].try_cast("int"), at["q"].try_cast("int")
    month, day = (q, p) if day_first else (p, q)
    # A number above 12 in the month's place is read as the day.
    swapped = ~month.between(1, 12) & month.between(13, 31) & day.between(1, 12)
    either = F.when(month.between(1, 12), F.concat_ws("-", month, day)).when(swapped, F.concat_ws("-", day, month))
    short = F.length(at["x"]) == 2
    century = F.when(short & (at["x"].try_cast("int") < _TURN_OF_CENTURY), "20").when(short, "19").otherwise("")
    named = F.floor((F.instr(F.lit("".join(MONTHS)), F.lower(at["n"])) + 2) / 3).cast("string")
    month_text = F.when(at["n"] != "", named).when(at["m"] != "", at["m"]).otherwise("1")
    plain = F.concat_ws("-", at["y"], month_text, F.when(at["d"] != "", at["d"]).otherwise("1"))
    return F.when(at["x"] != "", F.concat(century, at["x"], F.lit("-"), either)).otherwise(plain)


def _on_a_clock(date: Column, at: dict[str, Column]) -> Column:
    """The moment of a date and the tokens of its clock, in UTC if they name a zone."""
    hour, half, zone = at["H"].try_cast("int"), F.lower(at["A"]), at["Z"]
    hour = hour + F.when((half == "p") & (hour < 12), 12).when((half == "a") & (hour == 12), -12).otherwise(0)
    second = F.concat(F.when(at["S"] != "", at["S"]).otherwise("0"), F.lit("."), F.rpad(at["F"], 6, "0"))
    moment = F.concat(date, F.lit(" "), F.concat_ws(":", hour, at["M"], second)).try_cast("timestamp_ntz")
    digits = F.replace(zone, F.lit(":"), F.lit(""))
    ahead = F.when(zone.startswith("-"), 1).otherwise(-1)
    shift = F.make_dt_interval(F.lit(0), ahead * F.substring(digits, 2, 2).try_cast("int"), ahead * F.substring(digits, 4, 2).try_cast("int"))
    return F.when(F.left(zone, F.lit(1)).isin("+", "-"), moment + shift).otherwise(moment)


def to_ts(c: Column, t: DataType, day_first: bool = False) -> Column:
    """The cell as a timestamp without zone, NULL when it is not a date. Month comes first by default;
    a number above 12 in its place is read as the day. A moment with a zone is given in UTC."""
    if is_temporal(t):
        return c.cast("timestamp_ntz")
    if not is_text(t):
        return F.lit(None).cast("timestamp_ntz")

    def moment(tokens: Column) -> Column:
        at = {token: tokens[i] for i, token in enumerate(_TOKENS)}
        date = _date_text(at, day_first)
        read = F.when(at["H"] == "", date.try_cast("timestamp_ntz")).otherwise(_on_a_clock(date, at))
        return F.when(F.size(tokens) == len(_TOKENS), read)

    text = trim_ws(c)
    return F.when(F.length(text) <= _LONGEST, once(F.split(F.regexp_replace(text, _MOMENT, _TO_TOKENS), _BREAK), moment))


def parse_date(value, day_first: bool = False) -> datetime | None:
    """A caller's value as a date, by the same rules as :func:`to_ts`; None when it is not one."""
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    text = "" if value is None else str(value).strip()
    found = re.match(_MOMENT, text, re.ASCII) if len(text) <= _LONGEST else None
    if not found:
        return None
    at = {t: next((g for g, of in zip(found.groups(), _GROUPS, strict=True) if of == t and g), "") for t in _TOKENS}
    year, month, day = at["y"] or at["x"], at["m"] or "1", at["d"] or "1"
    if at["x"]:
        month, day = (at["q"], at["p"]) if day_first else (at["p"], at["q"])
        if int(month) > 12:
            month, day = day, month
        if len(year) == 2:
            year = ("20" if int(year) < _TURN_OF_CENTURY else "19") + year
    if at["n"]:
        month = MONTHS.index(at["n"].lower()) + 1
    hour, half, zone = int(at["H"] or 0), at["A"].lower(), at["Z"]
    hour += 12 if half == "p" and hour < 12 else -12 if half == "a" and hour == 12 else 0
    try:
        read = datetime(int(year), int(month), int(day), hour, int(at["M"] or 0), int(at["S"] or 0), int(f"{at['F']:0<6}"))
        if zone[:1] in ("+", "-"):
            shift = timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]))
            read += shift if zone[0] == "-" else -shift
    except (ValueError, OverflowError):
        return None
    return read


def date_literal(moment: datetime, t: DataType | None = None) -> Column:
    """A literal in the column's own type, so the comparison reaches the scan."""
    literal = F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
    return literal.cast(t) if t is not None and is_temporal(t) else literal

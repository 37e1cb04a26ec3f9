"""Names of columns and tables. Plain Python on the driver: names are metadata, not data."""

from __future__ import annotations

import re
from collections.abc import Callable, Container
from itertools import count
from pathlib import PurePosixPath


def norm_col(name: str) -> str:
    """A column name for matching: 'Customer ID', 'customer_id' and 'CustomerID' are one."""
    return re.sub("[^a-z0-9]", "", name.lower())


def column_letter(position: int) -> str:
    """Spreadsheet letters of a 0-based column position: A..Z, AA.."""
    letters = ""
    while position >= 0:
        letters = chr(ord("A") + position % 26) + letters
        position = position // 26 - 1
    return letters


def table_name(path: str) -> str:
    """A table is called like its file, without folder and ending."""
    return PurePosixPath(path.replace("\\", "/")).stem.strip() or "table"


def unused_name(name: str, taken: Container[str], numbered: Callable[[int], str] | None = None) -> str:
    """``name`` if it is free, else with the smallest number from 2 on that makes it so."""
    numbered = numbered or (lambda n: f"{name} ({n})")
    return name if name not in taken else next(v for v in map(numbered, count(2)) if v not in taken)


# What a sheet label may not hold, and how long a name in it and the whole label may be.
_LABEL_FORBIDDEN = r"[:\\/?*\[\]]"
_LABEL_STEM = 28
_LABEL_LENGTH = 31


def sheet_label(name: str, taken: Container[str]) -> str:
    """A table name made safe as a sheet or directory label, unique among ``taken``; a number shortens the name, not itself."""
    stem = re.sub(_LABEL_FORBIDDEN, " ", name).strip()[:_LABEL_STEM] or "Sheet"
    return unused_name(stem, taken, lambda n: f"{stem[: _LABEL_LENGTH - 1 - len(str(n))]} {n}")

"""Header recovery for delimited text: titles above the header, blank names, phantom and repeated columns.

Works on the first line and the first two rows; the rest of the file is never brought to the driver.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from tablewright.functions.naming import column_letter


def parse_line(line: str, separator: str = ",") -> list[str]:
    return next(csv.reader([line.lstrip("﻿")], delimiter=separator), [])


@dataclass(frozen=True)
class Header:
    """``names[i]`` is the name of the i-th column read, None while it has none; ``kept`` are positions."""

    names: tuple[str | None, ...]
    kept: tuple[int, ...]

    @classmethod
    def of(cls, cells: Sequence[str | None]) -> Header:
        return cls(tuple((c or "").strip() or None for c in cells), tuple(range(len(cells))))

    @property
    def unnamed(self) -> list[int]:
        return [i for i in self.kept if self.names[i] is None]

    def without(self, phantom: Sequence[int]) -> Header:
        return Header(self.names, tuple(i for i in self.kept if i not in phantom))

    def title_above(self, first_row: Sequence[str | None], rows_seen: int) -> bool:
        """The line read as header is a title: mostly blank, over a fuller first row that names the columns.

        Fixed rule: at least two rows; at least as many blank names as others; a first row that fills more, and all but one column.
        """
        blank, named = len(self.unnamed), len(self.kept) - len(self.unnamed)
        filled = sum(first_row[i] is not None for i in self.kept)
        return rows_seen >= 2 and blank >= max(1, named) and filled > named and filled >= len(self.kept) - 1

    def promoted(self, first_row: Sequence[str | None]) -> Header:
        names = [(v or "").strip() or n for v, n in zip(first_row, self.names)]
        return Header(tuple(names), self.kept)

    def final_names(self) -> list[str]:
        """Unique names of the kept columns: a repeat gets ``.1``, ``.2``; a blank one its letter."""
        final: list[str] = []
        for place, i in enumerate(self.kept):
            name = self.names[i] or f"Column {column_letter(place)}"
            if name in final:
                n = 1
                while f"{name}.{n}" in final or f"{name}.{n}" in self.names:
                    n += 1
                name = f"{name}.{n}"
            final.append(name)
        return final



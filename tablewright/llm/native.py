"""Columns over the words of a text, in Spark's own functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the word rule, and all ASCII characters but letters and digits.
SPACES = r"[\x20\x09-\x0D]+"
NO_LETTERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lowered(text: Column) -> Column:
    """Letters A-Z in lower case; no others."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, gaps: str) -> Column:
    return F.filter(F.split(text, gaps), lambda w: w != "")


def hashes(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(w))


def upto(last: Column) -> Column:
    """0 .. last; none where last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def grams(hashed: Column, offsets: list[int]) -> Column:
    """For every place of an array of hashes, the hash of the elements at the given offsets from it."""
    return F.transform(upto(F.size(hashed) - 1 - max(offsets)), lambda i: F.xxhash64(*[F.get(hashed, i + o) for o in offsets]))

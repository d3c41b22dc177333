"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed and carriage return: what parts words.
WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; null and blank texts have none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def window_hashes(hashes: Column, width: int) -> Column:
    """A 64-bit hash of each run of ``width`` consecutive entries of an array of word hashes."""
    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - width)
        return F.when(F.size(h) < width, F.array().cast("array<bigint>")).otherwise(
            F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))

    return let(hashes, windows)

"""Words, lower-casing and shingles as column expressions, and the names that helper columns may take.

A word is a longest run of characters outside space and the control characters 9 to 13. Only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text, none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def windows(items: Column, size: int, make: Callable[..., Column]) -> Column:
    """``make(item, item, ...)`` of each run of ``size`` items; ``items`` must be cheap to name (a column or a let)."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(items) - size, F.lit(0)))
    each = F.transform(starts, lambda i: make(*[F.get(items, i + j) for j in range(size)]))
    return F.when(F.size(items) >= size, each)


def shingles(text: Column, size: int, joined: bool = False) -> Column:
    """Distinct ``size``-word shingles of a lower-cased text, as 64-bit hashes or as text.

    A text with fewer words is one shingle; a text without words has none.
    """

    def make(*parts: Column) -> Column:
        return F.concat_ws(" ", *parts) if joined else F.xxhash64(*parts)

    def of(found: Column) -> Column:
        short = F.array(F.concat_ws(" ", found) if joined else F.xxhash64(found))
        empty = F.array().cast("array<string>" if joined else "array<bigint>")
        return F.when(F.size(found) == 0, empty).when(F.size(found) < size, short).otherwise(windows(found, size, make))

    return F.array_distinct(let(words(lowered(text)), of))


def spare(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

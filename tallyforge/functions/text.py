"""Scalar text functions (all built-in expressions, no UDF)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes for which a limit keeps its last digit.
MARKER_EXEMPT_CODES = ("0762", "4208", "4199")


def phone_format(number: Column) -> Column:
    """``1234567890`` -> ``123-456-7890``."""
    return F.concat_ws("-", F.substring(number, 1, 3), F.substring(number, 4, 3), F.substring(number, 7, 4))


def after_nth(text: Column, letter: str, n: int) -> Column:
    """Text after the n-th occurrence of ``letter`` in either case; '' when there are fewer."""
    either = "".join(f"[{re.escape(c.lower())}{re.escape(c.upper())}]" if len(c.lower()) == len(c.upper()) == 1 else re.escape(c) for c in letter)
    parts = F.split(text, either, n + 1)
    return F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(F.get(parts, F.lit(n)), F.lit("")))


def _whole(text: Column) -> Column:
    return F.substring_index(text, ".", 1)


def _fraction(text: Column) -> Column:
    return F.when(F.instr(text, ".") > 0, F.substr(text, F.instr(text, ".") + 1)).otherwise(F.lit(""))


def marker_append(text: Column) -> Column:
    """Append '1' to the whole part unless it ends in '1' already; text without '.' stays."""
    whole = _whole(text)
    marked = F.when(whole.endswith("1"), whole).otherwise(F.concat(whole, F.lit("1")))
    return F.when(F.instr(text, ".") > 0, F.concat(marked, F.substr(text, F.instr(text, ".")))).otherwise(text)


def marker_append_rows(df: DataFrame, column: str, name: str = "modified_value") -> DataFrame:
    return df.where(F.col(column).isNotNull()).withColumn(name, marker_append(F.col(column)))


def marker_replace(
    marker: Column, code: Column, limit: Column, exempt: Sequence[str] = MARKER_EXEMPT_CODES
) -> Column:
    """Replace the last whole-part digit of ``limit`` by '1' where the marker is 1 and the code is not exempt."""
    whole, fraction = _whole(limit), _fraction(limit)
    changed = F.concat(
        F.substr(whole, F.lit(1), F.greatest(F.length(whole) - 1, F.lit(0))),
        F.lit("1"),
        F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit("")),
    )
    return F.when((marker == 1) & ~code.isin(*exempt), changed).otherwise(limit)


def split_number(text: Column) -> Column:
    """Struct ``integer_part, decimal_part``; no '.' gives an empty decimal part."""
    return F.when(
        text.isNotNull(), F.struct(_whole(text).alias("integer_part"), _fraction(text).alias("decimal_part"))
    )


def filename_iso_date(name: Column) -> Column:
    """Date between underscores, ``..._yyyy-MM-dd_...``; NULL when absent or not a date."""
    return F.regexp_extract(name, r".*_([0-9]{4}-[0-9]{2}-[0-9]{2})_", 1).try_cast("date")


def filename_dmy_date(name: Column) -> Column:
    """First ``dd-MM-yyyy`` anywhere in the name; NULL when absent or not a date."""
    found = F.regexp_extract(name, r"([0-9]{2}-[0-9]{2}-[0-9]{4})", 1)
    iso = F.concat_ws("-", F.substring(found, 7, 4), F.substring(found, 4, 2), F.substring(found, 1, 2))
    return iso.try_cast("date")


def text_lines(df: DataFrame, column: str, name: str = "line") -> DataFrame:
    """One row per line of a text cell, with its 0-based position in the cell."""
    others = [F.col(c) for c in df.columns if c != column]
    return df.select(*others, F.posexplode(F.split(F.col(column), "\n")).alias("line_pos", name))


def parse_list(text: Column) -> Column:
    """``["a","b"]`` list text -> array; empty text or brackets -> empty array."""
    bare = F.regexp_replace(text, r'[\[\]"]', "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, ","))

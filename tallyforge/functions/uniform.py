"""Seeded uniform numbers that any SQL engine can recompute.

``rand()`` depends on partitioning and changes when a lost task is rerun; these
values depend on the salt and the row's key only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hexadecimal digits, all of which a double holds exactly.
DIGITS = 13
TWO_POW_52 = 4503599627370496.0


def key_digest(salt: str, *keys: Column | str) -> Column:
    """32 hex digits of ``salt:key[:key...]``; NULL keys count as empty text."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(salt), *parts))


def hex_to_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def uniform(salt: str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of the digest."""
    return hex_to_long(F.substring(key_digest(salt, *keys), 1, DIGITS)) / F.lit(TWO_POW_52)

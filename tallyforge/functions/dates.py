"""Date functions. "Now" is always an argument, so that a result can be repeated."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def plus_days(day: Column, days: int = 10) -> Column:
    return F.date_add(day.cast("date"), days)


def is_anniversary(day: Column, as_of: str | dt.date | Column) -> Column:
    """True where month and day equal those of ``as_of``."""
    reference = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")
    return F.date_format(day, "MM-dd") == F.date_format(reference, "MM-dd")


def time_text(moment: Column | dt.datetime | None = None, pattern: str = "yyyy-MM-dd_HH-mm-ss") -> Column:
    """A moment as text; the session's current time only when none is given."""
    if moment is None:
        moment = F.current_timestamp()
    elif not isinstance(moment, Column):
        moment = F.lit(moment)
    return F.date_format(moment, pattern)

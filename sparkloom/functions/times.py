"""Times as numbers, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(at: str | Column) -> Column:
    """Microseconds since 1970 of a time without zone (or of one with, as the session shows it)."""
    column = F.col(at) if isinstance(at, str) else at
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), column.cast("timestamp_ntz"))


def at_micros(n: Column) -> Column:
    """The time without zone so many microseconds after 1970 begins."""
    return F.timestamp_add("MICROSECOND", n, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))

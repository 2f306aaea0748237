"""Small column expressions: null-aware inequality, minutes and microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINUTE_US = 60_000_000


def ne(a: Column, b: Column) -> Column:
    """Inequality in which a missing side counts as different."""
    return F.coalesce(a != b, F.lit(True))


def is_true(c: Column) -> Column:
    """Missing counts as false."""
    return F.coalesce(c, F.lit(False))


def micros_between(start: Column, end: Column) -> Column:
    """Exact for zone-less timestamps in any session time zone, unlike a timestamp_diff."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(1_000_000)).cast(T.LongType())


def add_micros(ts: Column, micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, ts)


def minutes_to_micros(minutes: Column) -> Column:
    """Fractional minutes to whole microseconds, truncated."""
    return (minutes * F.lit(60.0) * F.lit(1e6)).cast(T.LongType())


def minutes_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(6e7)


def no_nan(c: Column) -> Column:
    """Missing numbers are null everywhere in this package, never NaN."""
    return F.when(~F.isnan(c), c)

"""Row and column selections used around the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators.zone import normalise_timestamp
from meterline.params import EFFECTIVE, Params, Profile
from meterline.schema import METER, TS, require

# Columns dropped before sessionising again, and before exporting one meter.
RESESSION_DROPS = (
    "fetch_index",
    "timestamp_issue",
    "diff_next_timestamp",
    "diff_prev_timestamp",
    "energy_gap_time_datetime",
    "timestamp_load",
    "energy_gap_to_next",
    "energy_gap_to_prev",
    "load",
)
EXPORT_DROPS = (
    "timezone",
    "fetch_index",
    "voltage",
    "power_factor",
    "frequency",
    "load_count",
    "timestamp_issue",
    "diff_next_timestamp",
    "diff_prev_timestamp",
    "energy_gap_time_datetime",
    "region",
    "timestamp_load",
    "meter_number",
    "energy_gap_to_next",
    "energy_gap_to_prev",
    "load",
)
ROW_ORDER_HELPERS = ("end_added", "end_source", "start_added", "start_source")


def period(
    df: DataFrame,
    start: str = Params.period_start,
    end: str = Params.period_end,
    profile: Profile = EFFECTIVE,
) -> DataFrame:
    """Rows from the first day's midnight up to, not including, the last day's."""
    require(df, TS)
    df = normalise_timestamp(df)
    ts = F.col(TS)
    inside = (ts >= F.lit(f"{start} 00:00:00").cast("timestamp_ntz")) & (
        ts < F.lit(f"{end} 00:00:00").cast("timestamp_ntz")
    )
    return df.filter(inside | ts.isNull() if profile.keep_null_timestamps else inside)


def of_meter(df: DataFrame, meter: int) -> DataFrame:
    """One meter's rows; the filter reaches the scan through every per-meter window."""
    return df.filter(F.col(METER) == meter)


def for_resession(df: DataFrame) -> DataFrame:
    return df.drop(*RESESSION_DROPS)


def for_export(df: DataFrame) -> DataFrame:
    """The columns of an export, in recording order."""
    return df.orderBy("id", TS).drop(*EXPORT_DROPS, *ROW_ORDER_HELPERS)


def first_rows(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first rows in row order (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, order: list[str], n: int = 60) -> DataFrame:
    """The last rows in row order, in that order."""
    tail = df.orderBy(*[F.desc(c) for c in order]).limit(n)
    return tail.orderBy(*order)


def longest(df: DataFrame, ties: list[str], n: int = 20) -> DataFrame:
    """Rows of the longest events; rows without a duration come last."""
    return df.orderBy(F.desc_nulls_last("cooking_time"), *ties).limit(n)

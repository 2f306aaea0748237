"""Time zone repair of a whole frame of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.params import EFFECTIVE, Profile
from meterline.schema import TS

# The zone that triggers the repair, the zone after it, and the shift between them.
SERVER_ZONE = "UTC+00:00"
LOCAL_ZONE = "UTC+03:00"
SHIFT_HOURS = 3
SHIFT = f"INTERVAL '{SHIFT_HOURS}' HOUR"


def normalise_timestamp(df: DataFrame) -> DataFrame:
    """Zone-less timestamps, parsed where they arrive as text."""
    return df.withColumn(TS, F.col(TS).cast("timestamp_ntz"))


def any_server_zone(df: DataFrame, profile: Profile) -> Column:
    """Scalar: does any row carry the server zone? A one-row subquery over one column.

    Read as a regular expression the ``+`` is a quantifier, so the literal zone text never
    matches; the literal mode does what the zone text says.
    """
    zone = F.col("timezone")
    hit = zone.rlike(SERVER_ZONE) if profile.zone_match == "regex" else zone.contains(SERVER_ZONE)
    return df.agg(F.coalesce(F.bool_or(hit), F.lit(False))).scalar()


def shift_zone(df: DataFrame, profile: Profile = EFFECTIVE) -> DataFrame:
    """Move all rows to local time if any row is in the server zone (or always)."""
    df = normalise_timestamp(df)
    later = F.col(TS) + F.expr(SHIFT)
    if profile.zone_match == "always":
        return df.withColumns({TS: later, "timezone": F.lit(LOCAL_ZONE)})
    shift = any_server_zone(df, profile)
    return df.withColumns(
        {
            TS: F.when(shift, later).otherwise(F.col(TS)),
            "timezone": F.when(shift, F.lit(LOCAL_ZONE)).otherwise(F.col("timezone")),
        }
    )

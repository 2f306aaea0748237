"""Readings stored by day, so that a period reads the files it needs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.operators.zone import LOCAL_ZONE, SHIFT, SHIFT_HOURS, any_server_zone, normalise_timestamp
from meterline.params import EFFECTIVE, Params, Profile
from meterline.schema import METER, TS, require
from meterline.sources.files import normalise

DAY = "recorded_day"


def write_by_day(df: DataFrame, path: str) -> None:
    """A Parquet folder a day as recorded, before any shift of zone; readings without a time have their own.

    Ranges of (day, time, meter) are dealt to tasks, so a crowded day is written by many of them, a
    day's files hold narrow ranges of time, and no task opens many days.
    """
    require(df, METER, TS)
    df = normalise_timestamp(df).withColumn(DAY, F.to_date(TS))
    order = [DAY, TS, METER]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(DAY).mode("overwrite").parquet(path)


def read_period(
    spark: SparkSession,
    path: str,
    start: str = Params.period_start,
    end: str = Params.period_end,
    profile: Profile = EFFECTIVE,
) -> DataFrame:
    """Readings in local time from the first day's midnight up to, not including, the last day's.

    The same rows as the zone shift of the whole folder followed by ``period``. Whether the shift
    applies is asked of the zone column alone; then the shift moves the bounds instead of the rows, and both
    the days and the times reach the scan as plain literals.
    """
    stored = spark.read.parquet(path)
    shifted = profile.zone_match == "always"
    if not shifted:
        shifted = stored.select(any_server_zone(stored, profile).alias("hit")).limit(1).collect()
        shifted = bool(shifted and shifted[0]["hit"])
    move = timedelta(hours=SHIFT_HOURS if shifted else 0)
    first, after = (datetime.fromisoformat(day) - move for day in (start, end))
    days = F.col(DAY).between(F.lit(first.date()), F.lit(after.date()))
    ts = F.col(TS)
    inside = (ts >= F.lit(str(first)).cast("timestamp_ntz")) & (ts < F.lit(str(after)).cast("timestamp_ntz"))
    if profile.keep_null_timestamps:
        days, inside = days | F.col(DAY).isNull(), inside | ts.isNull()
    chosen = normalise(stored.filter(days).filter(inside).drop(DAY))
    if not shifted:
        return chosen
    return chosen.withColumns({TS: ts + F.expr(SHIFT), "timezone": F.lit(LOCAL_ZONE)})

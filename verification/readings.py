"""Meter readings derived from the ``events`` table.

Each user is a meter; time is compressed a hundredfold so that the usual gap is a few minutes.
The counter is a running sum of whole watt-hours, so both engines get the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.exprs import micros_between
from meterline.operators.timeline import Frame
from meterline.params import Scale
from meterline.schema import METER

EPOCH = "2024-01-01 00:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def readings(
    spark: SparkSession, sf_dir: str, scale: Scale = Scale(), whole_seconds: bool = False,
    compress: int = 100,
) -> DataFrame:
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    since = micros_between(epoch, F.col("ts").cast("timestamp_ntz"))
    # Whole-number division; offsets are never negative.
    offset = (since - F.pmod(since, F.lit(compress))) / F.lit(compress)
    offset = offset.cast("bigint")
    if whole_seconds:
        offset = offset - F.pmod(offset, F.lit(1_000_000))
    error = F.col("event_type") == "error"
    raw = events(spark, sf_dir).select(
        F.col("user_id").alias(METER),
        F.col("event_id").alias("id"),
        F.timestamp_add("MICROSECOND", offset, epoch).alias("timestamp"),
        F.when(error, 0).otherwise(F.floor(F.col("value") / 5) * 5).cast("bigint").alias("_wh"),
        F.when(error, 0.0).otherwise(F.floor("value") / 200).cast("double").alias("power"),
        F.when(F.col("event_id") % 97 == 0, 5000).otherwise(0).cast("bigint").alias("_spike"),
        F.when(F.col("event_id") % 11 == 0, None)
        .otherwise(230 + F.col("event_id") % 7)
        .cast("double")
        .alias("voltage"),
    )
    counted = Frame.split(raw, scale).map(
        lambda df, layout: layout.running(df, sums={"_total": F.col("_wh")})
    )
    return counted.union().select(
        METER,
        "id",
        "timestamp",
        F.lit("UTC+03:00").alias("timezone"),
        ((F.col("_total") + F.col("_spike")).cast("double") / 1000).alias("energy"),
        "power",
        "voltage",
        (F.col("power") * 1000 / F.col("voltage")).alias("current"),
    )


def replayed(readings: DataFrame) -> DataFrame:
    """Readings of which two hours in eight of each meter are sent again, 125 minutes late, with new ids."""
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    slot = F.expr("hours div 2")
    again = readings.withColumn("hours", F.timestamp_diff("HOUR", epoch, F.col("timestamp")))
    again = again.filter((F.col(METER) + slot) % 4 == 0).drop("hours")
    late = F.timestamp_add("MINUTE", F.lit(125), F.col("timestamp"))
    return readings.unionByName(again.withColumns({"id": F.col("id") + 100_000_000, "timestamp": late}))


def with_long_spikes(readings: DataFrame) -> DataFrame:
    """Three long meters, and a counter that is 20 kWh too high during every fourth half hour."""
    minutes = F.timestamp_diff("MINUTE", F.lit(EPOCH).cast("timestamp_ntz"), F.col("timestamp"))
    high = F.pmod(F.floor(minutes / 30), F.lit(4)) == 1
    return readings.withColumns(
        {METER: F.col(METER) % 3, "energy": F.col("energy") + F.when(high, 20.0).otherwise(0.0)}
    )

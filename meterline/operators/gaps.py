"""Energy counted between events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators.extend import add_gap
from meterline.operators.timeline import Frame
from meterline.params import EFFECTIVE, Profile, Scale
from meterline.schema import EVENT, METER, TS, require


def gaps_to_next(df: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Energy still missing between each event and the next reading of its meter."""
    require(df, METER, TS, "id", "energy", EVENT)
    frame = Frame.split(df, scale)
    return frame.map(
        lambda rows, layout: add_gap(rows, layout, "gaps_to_next_server_issue", forward=True)
    ).union()


def gap_energy_total(df: DataFrame, profile: Profile = EFFECTIVE) -> DataFrame:
    """Total energy in positive gaps behind events; added rows repeat the gap of the row they extend."""
    gap = F.col("energy_gap_to_next")
    for added in ("end_added", "start_added"):
        if added in df.columns:
            df = df.filter(F.coalesce(F.col(added), F.lit(0)) == 0)
    return df.filter(gap > profile.min_gap).agg(F.sum(gap).alias("energy_gap_total"))


def distinct_events(df: DataFrame) -> DataFrame:
    """Exact number of events; rows outside events do not count."""
    return df.agg(F.count_distinct(EVENT).alias("events"))

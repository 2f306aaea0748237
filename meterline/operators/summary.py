"""One row per event: energy, duration, power and cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.exprs import ne
from meterline.operators.pinning import pin
from meterline.operators.sessions import RAW_EVENT, event_offsets
from meterline.operators.timeline import POS, STRIP, Frame, Layout, with_positions
from meterline.params import EFFECTIVE, Params, Profile, Scale
from meterline.schema import EVENT, METER, TS, require


def _measures(profile: Profile, inside: Column) -> list[Column]:
    """What an event is measured by, over its rows that are ``inside`` it."""

    def value(name: str) -> Column:
        return F.when(inside, F.col(name))

    counted = value("voltage") if profile.count_voltages else F.when(inside, 1)
    energy = value("energy")
    return [
        F.max(energy).alias("energy"),
        (F.max(energy) - F.min(energy)).alias("energy_gen"),
        F.avg(value("power")).alias("power"),
        F.max(value("cooking_time")).alias("cooking_time"),
        F.min(value(TS)).alias(TS),
        F.avg(value("current")).alias("current"),
        F.count(counted).alias("no_recordings"),
        F.avg(value("id")).alias("id"),
    ]


def event_energy(df: DataFrame, profile: Profile = EFFECTIVE) -> DataFrame:
    """Aggregates of each event. Partial aggregation keeps heavy meters and events spread out."""
    inside = F.col(EVENT).isNotNull()
    return df.filter(inside).groupBy(METER, EVENT).agg(*_measures(profile, F.lit(True)))


def add_cost(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Mean power over the event's duration and what its energy costs."""
    hours = F.col("cooking_time") / F.lit(60)
    return df.withColumns(
        {
            "power_mean": F.try_divide("energy_gen", hours),
            "cooking_cost": F.col("energy_gen") * F.lit(params.tzs_per_kwh),
        }
    )


def add_event_count(
    events: DataFrame, scale: Scale = Scale(), shared_numbers: bool = False
) -> DataFrame:
    """Running number of the event in (meter, event) order.

    ``shared_numbers`` counts neighbouring rows with the same event number once, which
    happens when an event ran on from one meter to the next.
    """
    events = with_positions(events, [METER, EVENT])
    if not shared_numbers:
        return events.withColumn("event_count", F.col(POS) + 1).drop(POS)
    layout = Layout((POS,), scale.strip_rows, stacked=True)
    events = events.withColumn(STRIP, F.floor(F.col(POS) / F.lit(scale.strip_rows)))
    events = layout.neighbours(
        events,
        1,
        0,
        lambda rows: rows.withColumn(
            "_new", ne(F.col(EVENT), F.lag(EVENT).over(layout.window)).cast("bigint")
        ),
    )
    return layout.running(events, sums={"event_count": F.col("_new")}).drop(POS, STRIP, "_new")


def only_events(
    df: DataFrame,
    params: Params = Params(),
    profile: Profile = EFFECTIVE,
    scale: Scale = Scale(),
    shared_numbers: bool = False,
) -> DataFrame:
    """The event table of sessionised readings."""
    require(df, METER, EVENT, TS, "energy", "power", "cooking_time", "current", "voltage", "id")
    events = add_cost(event_energy(df, profile), params)
    return add_event_count(events, scale, shared_numbers)


def event_table(frame: Frame, params: Params, profile: Profile) -> DataFrame:
    """The event table of a session frame whose events are numbered within their meter.

    Disqualified events are aggregated too, because they count in the numbering; so the numbers
    come from this small table and the frame is read once.
    """
    inside = F.col(EVENT).isNotNull()

    def measure(df: DataFrame) -> DataFrame:
        return df.filter(F.col(METER).isNotNull()).groupBy(METER, RAW_EVENT).agg(
            *_measures(profile, inside), F.max(inside).alias("_kept")
        )

    events = pin(reduce(DataFrame.unionByName, [measure(p.df) for p in frame.parts]))
    starts = events.groupBy(METER).agg(F.count("*").alias("starts"))
    offsets, size = event_offsets(starts, frame.scale)
    if size <= frame.scale.scan_rows:
        offsets = F.broadcast(offsets)
    events = (
        events.filter("_kept")
        .join(offsets, METER)
        .withColumn(EVENT, F.col(RAW_EVENT) + F.col("before_starts"))
        .drop("_kept", RAW_EVENT, "before_starts")
    )
    return add_event_count(add_cost(events, params), frame.scale)

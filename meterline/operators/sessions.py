"""Splitting every meter's readings into numbered usage events."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.exprs import minutes_between
from meterline.operators.pinning import pin
from meterline.operators.rules import END, START, add_flags, add_loads
from meterline.operators.scan import exclusive_scan
from meterline.operators.timeline import POS, Frame, Layout, Part
from meterline.operators.zone import shift_zone
from meterline.params import EFFECTIVE, Params, Profile, Scale
from meterline.schema import EVENT, METER, TS, require

RAW_EVENT = "_event"  # number within the meter, before any event is disqualified


def add_context(frame: Frame, profile: Profile) -> Frame:
    """What a meter's first rows see of the meters before it.

    The columns of one stacked frame run on from meter to meter: latest load, load count and
    last counter value. They come from one summary row per meter, scanned in meter order.
    """
    nothing = {
        "_carried_load_ts": F.lit(None).cast("timestamp_ntz"),
        "_carried_loads": F.lit(0).cast("bigint"),
        "_carried_energy": F.lit(None).cast("double"),
        "_has_prev_meter": F.lit(False),
        "_is_last_meter": F.lit(False),
    }
    if all(p.layout.stacked for p in frame.parts):
        # The neighbours themselves are there to be seen.
        return frame.map(
            lambda df, _: df.withColumns(nothing | {"_is_last_meter": F.col("_is_last_row")})
        )
    if not (
        profile.loads_cross_meters
        or profile.last_frame_row_stays_open
        or profile.diff_crosses_meters
    ):
        return frame.map(lambda df, _: df.withColumns(nothing))

    # The summary would compute every step before a second time; strips are stored by the next step anyway.
    frame = replace(
        frame,
        parts=tuple(p if p.layout.striped else replace(p, df=p.layout.dealt(pin(p.df))) for p in frame.parts),
    )

    def summarise(part: Part) -> DataFrame:
        at = part.layout.key
        loaded = F.col("load").isNotNull()
        return part.df.groupBy(METER).agg(
            F.sum(loaded.cast("bigint")).alias("loads"),
            F.max(F.when(loaded, F.struct(at, F.col(TS).alias("v"))))["v"].alias("load_ts"),
            F.struct(
                F.max(F.struct(at, F.col("energy").alias("v")))["v"].alias("v")
            ).alias("energy"),
            F.min(F.struct(at, F.col(TS).cast("string").alias("v")))["v"].alias("first_ts"),
        )

    summary = pin(reduce(DataFrame.unionByName, [summarise(p) for p in frame.parts]))
    # A few values of the whole frame; one row reaches the driver.
    known = F.col(METER).isNotNull()
    facts = summary.agg(
        F.count(METER).alias("size"),
        F.min(F.when(known, F.struct(METER, "first_ts"))).alias("first"),
        F.max(METER).alias("last"),
        F.sum("loads").alias("loads"),
        F.max(F.when(known & F.col("load_ts").isNotNull(), F.struct(METER, F.col("load_ts").cast("string").alias("ts")))).alias("load"),
        F.max(F.when(~known, F.col("first_ts"))).alias("lone_ts"),
    ).first()
    size, first, lone = facts["size"], facts["first"], facts["lone_ts"] is not None
    if not size and not lone:
        return frame.map(lambda df, _: df.withColumns(nothing))
    frame_start = F.lit(first["first_ts"] if size else facts["lone_ts"]).cast("timestamp_ntz")
    context = exclusive_scan(
        summary.filter(known), ["loads"], ["load_ts", "energy"], size, frame.scale.scan_rows
    ).select(
        METER,
        F.coalesce("before_load_ts", frame_start).alias("_carried_load_ts"),
        F.col("before_loads").alias("_carried_loads"),
        F.col("before_energy")["v"].alias("_carried_energy"),
        (F.col(METER) != (first[METER] if size else 0)).alias("_has_prev_meter"),
        ((F.col(METER) == facts["last"]) & F.lit(not lone)).alias("_is_last_meter"),
    )
    if not profile.loads_cross_meters:
        context = context.withColumns({n: nothing[n] for n in ("_carried_load_ts", "_carried_loads")})
    if not profile.diff_crosses_meters:
        context = context.withColumn("_carried_energy", nothing["_carried_energy"])
    frame = frame.join_meters(context, size)
    if not lone:
        return frame
    # Rows without a meter number come last, behind all meters.
    crossing = profile.loads_cross_meters
    last_load = F.coalesce(F.lit(facts["load"]["ts"] if facts["load"] else None).cast("timestamp_ntz"), frame_start)
    behind = nothing | {"_has_prev_meter": F.lit(True)}
    if crossing:
        behind |= {"_carried_load_ts": last_load, "_carried_loads": F.lit(facts["loads"]).cast("bigint")}
    return frame.map(
        lambda df, _: df.withColumns({n: F.when(F.col(METER).isNull(), v).otherwise(F.col(n)) for n, v in behind.items()})
    )


def add_load_instances(df: DataFrame, layout: Layout) -> DataFrame:
    """Number and time of the latest load; a meter's first row stands in before any load."""
    loaded = F.col("load").isNotNull()
    if layout.stacked:
        opens = loaded | (F.col(POS) == 0)
    else:
        opens = loaded | (~F.col("_has_prev") & F.col("_carried_load_ts").isNull())
    df = layout.running(
        df,
        lasts={"timestamp_load": F.when(opens, F.col(TS))},
        sums={"load_count": loaded.cast("bigint")},
        lasts_before={"_prev_load_ts": F.when(opens, F.col(TS))},
    )
    across = F.col("energy") - F.col("_carried_energy")
    return df.withColumns(
        {
            "timestamp_load": F.coalesce("timestamp_load", "_carried_load_ts"),
            "_prev_load_ts": F.coalesce("_prev_load_ts", "_carried_load_ts"),
            "load_count": F.col("load_count") + F.col("_carried_loads"),
            "_gain": F.coalesce("_gain", F.when(~F.col("_has_prev"), across)),
        }
    )


def flag_frame(frame: Frame, params: Params, profile: Profile) -> Frame:
    """Loads, latest load and start/end flags of every reading."""
    frame = frame.map(lambda df, layout: add_loads(df, layout, params, profile))
    frame = add_context(frame, profile)
    frame = frame.map(add_load_instances)
    return frame.map(lambda df, layout: add_flags(df, layout, params, profile))


def number_in_meter(df: DataFrame, layout: Layout) -> DataFrame:
    return layout.running(df, sums={RAW_EVENT: F.col(START).cast("bigint")})


def add_bounds(df: DataFrame, layout: Layout, profile: Profile) -> DataFrame:
    """First and last time and energy of the row's event."""
    at = layout.key

    def known(when: Column = F.lit(True)) -> Column:
        value = F.struct(at.alias("at"), F.col("energy").alias("v"))
        return F.when(F.col("energy").isNotNull() & when, value)

    if layout.stacked:  # time may jump back between meters, so the row order decides
        def first_ts(when: Column = F.lit(True)) -> Column:
            return F.when(when, F.struct(at.alias("at"), F.col(TS).alias("v")))

        last_ts, plain = first_ts(), {"_any_flag"}
    else:
        def first_ts(when: Column = F.lit(True)) -> Column:
            return F.when(when, F.col(TS))

        last_ts, plain = F.col(TS), {"_any_flag", "time_start", "time_end", "_flag_ts"}
    first = {"time_start": first_ts(), "energy_start": known()}
    last = {"time_end": last_ts, "energy_end": known()}
    flagged = F.col(END)
    if not profile.end_at_last_row:
        first |= {"_flag_ts": first_ts(flagged), "_flag_energy": known(flagged)}
        last["_any_flag"] = flagged
    df = layout.per_event(df, RAW_EVENT, smallest=first, largest=last, stored=True)
    df = df.withColumns(
        {n: F.col(n)["v"] for n in (*first, *last) if n not in plain}
    )
    if not profile.end_at_last_row:
        df = df.withColumns(
            {
                "time_end": F.when(F.col("_any_flag"), F.col("_flag_ts")).otherwise(
                    F.col("time_end")
                ),
                "energy_end": F.when(F.col("_any_flag"), F.col("_flag_energy")).otherwise(
                    F.col("energy_end")
                ),
            }
        )
    return df.drop("_flag_ts", "_flag_energy", "_any_flag")


def add_durations(df: DataFrame, params: Params) -> DataFrame:
    """Durations in minutes; events that are too short or too weak lose their number."""
    late = F.col(TS) > F.col("time_end")
    df = df.withColumns(
        {
            EVENT: F.when(late, None).otherwise(F.col(RAW_EVENT)),
            "time_start": F.when(late, None).otherwise(F.col("time_start")),
        }
    )
    df = df.withColumns(
        {
            "cooking_time": minutes_between(F.col("time_start"), F.col("time_end")),
            "seq_time": minutes_between(F.col("time_start"), F.col(TS)),
        }
    )
    # An event of one row starts here and has no later row of its own.
    single = (
        F.col(START)
        & (F.coalesce("_next_start", F.lit(True)) | (F.col("_next_ts") > F.col("time_end")))
        & (F.col("_gain") < params.min_cooking_event)
    )
    gained = F.col("energy_end") - F.col("energy_start")
    mean_power = F.try_divide(gained, F.col("cooking_time") / F.lit(60))
    weak = (gained < params.min_cooking_event) | (mean_power < params.power_mean_min)
    df = df.withColumn(EVENT, F.when(single, None).when(weak, None).otherwise(F.col(EVENT)))
    keep = F.col(EVENT).isNotNull()
    return df.withColumns(
        {
            "cooking_time": F.when(keep, F.col("cooking_time")),
            "seq_time": F.when(keep, F.col("seq_time")),
        }
    )


def event_offsets(starts: DataFrame, scale: Scale) -> tuple[DataFrame, int]:
    """Events of all meters before each meter, from one ``starts`` row per meter; and their number."""
    starts = pin(starts)
    size = starts.count()
    return exclusive_scan(starts, ["starts"], [], size, scale.scan_rows), size


def meter_starts(frame: Frame) -> DataFrame:
    """How many events each meter starts; rows without a meter number have no event that lasts."""
    counts = [
        p.df.filter(F.col(METER).isNotNull()).groupBy(METER).agg(F.sum(F.col(START).cast("bigint")).alias("starts"))
        for p in frame.parts
    ]
    return reduce(DataFrame.unionByName, counts)


def number_events(frame: Frame, starts: DataFrame) -> Frame:
    """Turn numbers within a meter into numbers within the frame, in meter order.

    ``starts`` has the events of each meter; rows without a meter number lose their numbers.
    """
    offsets, size = event_offsets(starts, frame.scale)
    numbers = [n for n in (RAW_EVENT, EVENT) if n in frame.parts[0].df.columns]
    return frame.join_meters(offsets, size).map(
        lambda df, _: df
        .withColumns({n: F.col(n) + F.col("before_starts") for n in numbers})
        .drop("before_starts")
    )


def event_group(df: DataFrame) -> str:
    """Column to group an event's rows by; rows outside kept events may be in a group too."""
    return RAW_EVENT if RAW_EVENT in df.columns else EVENT


HELPERS = (
    "_has_prev",
    "_has_next",
    "_gain",
    "_next_ts",
    "_next_start",
    "_carried_load_ts",
    "_carried_loads",
    "_carried_energy",
    "_has_prev_meter",
    "_is_last_meter",
    "_is_last_row",
    RAW_EVENT,
)


def session_frame(
    frame: Frame, params: Params, profile: Profile, numbered: bool = True, keep: bool = False
) -> Frame:
    """Sessionise a frame whose time zone is settled.

    ``numbered=False`` leaves event numbers unique within the meter only, which is all that
    later steps on the frame need and saves a pass over it. ``keep`` leaves the number before
    disqualification in the frame.
    """
    frame = frame.map(lambda df, _: df.drop(*_stale(profile)))
    frame = flag_frame(frame, params, profile)
    frame = frame.map(number_in_meter).by_event(RAW_EVENT)
    frame = frame.map(lambda df, layout: add_bounds(df, layout, profile))
    frame = frame.map(lambda df, _: add_durations(df, params))
    stacked = all(p.layout.stacked for p in frame.parts)  # numbers already run over the frame
    if numbered and not stacked:
        frame = frame.pin()
        frame = number_events(frame, meter_starts(frame))
    if keep:
        return frame.map(lambda df, _: df.drop(*[h for h in HELPERS if h != RAW_EVENT]))
    return frame.map(lambda df, _: df.drop(*HELPERS)).arrange()


def _stale(profile: Profile) -> tuple[str, ...]:
    """Columns of an earlier pass that the next one computes anew."""
    derived = (
        "cooking_start cooking_end cooking_event load_count timestamp_load time_start time_end "
        "energy_start energy_end cooking_time seq_time"
    ).split()
    carried = ("load", "diff_prev_timestamp", "diff_next_timestamp")
    return tuple(derived) if profile.keep_stale_columns else (*derived, *carried)


def prepare(df: DataFrame, profile: Profile) -> DataFrame:
    require(df, METER, TS, "id", "timezone", "energy", "power")
    return shift_zone(df, profile)


def metered(df: DataFrame) -> DataFrame:
    return df.filter(F.col(METER).isNotNull())


def with_unmetered(done: DataFrame, df: DataFrame) -> DataFrame:
    """Add the rows of ``df`` without a meter number to the processed ones.

    Such a row has no neighbour of its own meter: it starts an event, ends none, and the event of one
    row gains nothing, so it has no lasting event; columns that need other rows are null.
    """
    own = {START: F.lit(True), END: F.lit(False)}
    if "time_start" in done.columns:
        own |= {
            "time_start": F.col(TS),
            "time_end": F.col(TS),
            "energy_start": F.col("energy"),
            "energy_end": F.col("energy"),
        }
    unmetered = df.filter(F.col(METER).isNull())
    given = [c for c in unmetered.columns if c in done.columns and c not in own]
    columns = [
        (own[c] if c in own else F.col(c) if c in given else F.lit(None))
        .cast(done.schema[c].dataType)
        .alias(c)
        for c in done.columns
    ]
    return done.unionByName(unmetered.select(*columns))


def cooking_event(
    df: DataFrame,
    params: Params = Params(),
    profile: Profile = EFFECTIVE,
    scale: Scale = Scale(),
) -> DataFrame:
    """Readings with their session columns; rows outside any kept event have a null event.

    Rows without a meter number stay, behind all others and without a lasting event.
    """
    return session_frame(Frame.split(prepare(df, profile), scale), params, profile).union()


def event_conditions(
    df: DataFrame,
    params: Params = Params(),
    profile: Profile = EFFECTIVE,
    scale: Scale = Scale(),
) -> DataFrame:
    """Readings with loads and start/end flags only; rows without a meter number stay."""
    require(df, METER, TS, "id", "energy", "power")
    frame = flag_frame(Frame.split(df, scale), params, profile)
    return frame.map(lambda rows, _: rows.drop(*HELPERS)).union()

"""One Spark query per operator, over readings derived from the whole ``events`` table.

``QUERIES`` maps each name to the Spark callable and the SQL that must give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import meterline as m
from meterline.operators.gaps import distinct_events
from meterline.operators.pinning import ensure_checkpoint_dir
from meterline.operators.rules import add_loads
from meterline.operators.sessions import RAW_EVENT, session_frame
from meterline.operators.slices import (
    first_rows,
    for_export,
    for_resession,
    last_rows,
    longest,
    of_meter,
)
from meterline.operators.summary import add_cost, event_energy
from meterline.operators.timeline import Frame, row_order
from meterline.operators.zone import shift_zone
from meterline.params import DOCUMENTED, EFFECTIVE, NOTEBOOK, Params, Profile, Scale
from meterline.plans.pipelines import (
    DEFINITION_PARAMS,
    DEFINITION_PROFILE,
    definition_sessions,
    extended_sessions,
)
from meterline.sources.daily import read_period, write_by_day
from meterline.sources.files import read_csv, write_csv
from meterline.sources.folders import read_csv_folder
from meterline.sources.ordered import PLACE, read_ordered, write_ordered
from verification import oracle as o
from verification.readings import readings, replayed, with_long_spikes

Spark = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Spark, str]] = {}

DAY = Params(period_start="2024-01-01", period_end="2024-01-02")
# Small enough that every meter of the test tables is cut into strips.
SPLIT = Scale(hot_meter_rows=5, strip_rows=128)
FIRST_FLAG = replace(EFFECTIVE, end_at_last_row=False)


def query(name: str, sql: str):
    def register(fn: Spark) -> Spark:
        QUERIES[name] = (fn, sql)
        return fn

    return register


def fixed(c: str):
    """Six decimals; the bias keeps exact halves away from the rounding edge."""
    return F.floor(F.col(c) * 1000000 + F.lit(0.501)) / 1000000


def show(df: DataFrame, columns: list[str]) -> DataFrame:
    out = []
    for c in columns:
        source = "id" if c == "id_mean" else c
        out.append((fixed(source) if c in o.DOUBLES else F.col(source)).alias(c))
    return df.select(*out)


def clean(spark: SparkSession, sf: str, profile: Profile = EFFECTIVE, **kw) -> DataFrame:
    return m.remove_spikes(readings(spark, sf, **kw), profile=profile)


def sessions(spark: SparkSession, sf: str, profile: Profile = EFFECTIVE, **kw) -> DataFrame:
    return m.cooking_event(clean(spark, sf, profile, **kw), profile=profile)


# -- sources, projections, filters ---------------------------------------------------------------


@query("csv_roundtrip", o.base().select(o.shown(o.RAW_COLUMNS)))
def csv_roundtrip(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(readings(spark, sf), path)
    return show(read_csv(spark, path), o.RAW_COLUMNS)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "csv_mixed_headers",
    o.base().select(
        "meter_number, id, timestamp, " + o.fixed("energy") + " AS energy, "
        "CASE WHEN id % 3 = 2 THEN NULL ELSE " + o.fixed("power") + " END AS power, "
        "CASE WHEN id % 3 = 1 THEN 'late' END AS remark"
    ),
)
def csv_mixed_headers(spark, sf):
    """Three shipments into one folder: columns swapped, a column more, a column less."""
    path, df = new_path(spark, "mixed"), readings(spark, sf)
    shipments = (
        df.select("meter_number", "id", "timestamp", "energy", "power"),
        df.select("power", "energy", F.lit("late").alias("remark"), "timestamp", "id", "meter_number"),
        df.select("id", "meter_number", "energy", "timestamp"),
    )
    for n, shipment in enumerate(shipments):
        write_csv(shipment.filter(F.col("id") % 3 == n), f"{path}/{n}")
    rows = read_csv_folder(spark, f"{path}/*").rows
    return show(rows, ["meter_number", "id", "timestamp", "energy", "power", "remark"])


@query(
    "ordered_files",
    o.base().select(
        o.shown(o.RAW_COLUMNS) + ", row_number() OVER (ORDER BY voltage NULLS FIRST, timestamp, id) - 1 AS place"
    ),
)
def ordered_files(spark, sf):
    """Positions of the rows in a folder of ordered files, as they are read one after the other."""
    path, df = new_path(spark, "ordered"), readings(spark, sf)
    write_ordered(df, path, ["voltage", "timestamp", "id"])
    return show(read_ordered(spark, path), [*o.RAW_COLUMNS, PLACE])


def _daily_query(name: str, zone: str, profile: Profile) -> None:
    columns = ["meter_number", "id", "timestamp", "timezone", "energy"]
    sql = (
        o.base(profile, compress=1)
        .change(
            timestamp="CASE WHEN id % 13 = 0 THEN NULL ELSE timestamp END",
            timezone=f"CASE WHEN id % 101 = 0 THEN '{zone}' ELSE timezone END",
        )
        .zone()
        .period("2024-01-05", "2024-01-20")
        .select(o.shown(columns))
    )

    @query(name, sql)
    def run(spark, sf):
        path, df = new_path(spark, "daily"), _zones(readings(spark, sf, compress=1), zone)
        write_by_day(df.withColumn("timestamp", F.when(F.col("id") % 13 != 0, F.col("timestamp"))), path)
        return show(read_period(spark, path, "2024-01-05", "2024-01-20", profile), columns)


def _zones(df: DataFrame, zone: str) -> DataFrame:
    return df.withColumn(
        "timezone", F.when(F.col("id") % 101 == 0, F.lit(zone)).otherwise(F.col("timezone"))
    )


def _zone_query(name: str, zone: str, profile: Profile) -> None:
    columns = ["meter_number", "id", "timestamp", "timezone"]
    sql = (
        o.base(profile)
        .change(timezone=f"CASE WHEN id % 101 = 0 THEN '{zone}' ELSE timezone END")
        .zone()
        .select(o.shown(columns))
    )

    @query(name, sql)
    def run(spark, sf):
        return show(shift_zone(_zones(readings(spark, sf), zone), profile), columns)


_daily_query("period_files", "UTC+00:00", EFFECTIVE)
_daily_query("period_files_shifted", "UTC00:00", EFFECTIVE)
_daily_query("period_files_documented", "UTC+00:00", DOCUMENTED)
_zone_query("tz_normalise_regex", "UTC+00:00", EFFECTIVE)
_zone_query("tz_normalise_regex_match", "UTC00:00", EFFECTIVE)
_zone_query("tz_normalise_literal", "UTC+00:00", DOCUMENTED)
_zone_query("tz_shift_always", "UTC+03:00", DEFINITION_PROFILE)


@query("meter_filter", o.base().select(o.shown(o.RAW_COLUMNS), "WHERE meter_number = 7"))
def meter_filter(spark, sf):
    return show(of_meter(readings(spark, sf), 7), o.RAW_COLUMNS)


@query(
    "project_drop_rename",
    o.base().select("meter_number, id, timestamp, floor(energy * 1000000 + 0.501::DOUBLE) / 1000000 "
                    "AS energy_kwh, floor(power * 1000000 + 0.501::DOUBLE) / 1000000 AS power_kw"),
)
def project_drop_rename(spark, sf):
    df = show(readings(spark, sf), o.RAW_COLUMNS).drop("timezone", "voltage", "current")
    return df.withColumnsRenamed({"energy": "energy_kwh", "power": "power_kw"})


def _period_query(name: str, profile: Profile) -> None:
    columns = ["meter_number", "id", "timestamp", "energy"]
    sql = (
        o.base(profile, compress=1)
        .change(timestamp="CASE WHEN id % 13 = 0 THEN NULL ELSE timestamp END")
        .period("2024-01-05", "2024-01-20")
        .select(o.shown(columns))
    )

    @query(name, sql)
    def run(spark, sf):
        df = readings(spark, sf, compress=1)
        df = df.withColumn("timestamp", F.when(F.col("id") % 13 != 0, F.col("timestamp")))
        return show(m.period(df, "2024-01-05", "2024-01-20", profile), columns)


_period_query("period_slice", EFFECTIVE)
_period_query("period_slice_documented", DOCUMENTED)


# -- spikes, differences, loads, rules -----------------------------------------------------------

SPIKE_COLUMNS = ["meter_number", "id", "timestamp", "energy"]


@query("remove_spikes", o.base().despike().select(o.shown(SPIKE_COLUMNS)))
def remove_spikes(spark, sf):
    return show(clean(spark, sf), SPIKE_COLUMNS)


@query("remove_spikes_fixpoint", o.base(DOCUMENTED).despike().select(o.shown(SPIKE_COLUMNS)))
def remove_spikes_fixpoint(spark, sf):
    return show(clean(spark, sf, DOCUMENTED), SPIKE_COLUMNS)


@query("remove_spikes_split_meters", o.base().despike().select(o.shown(SPIKE_COLUMNS)))
def remove_spikes_split_meters(spark, sf):
    return show(m.remove_spikes(readings(spark, sf, SPLIT), scale=SPLIT), SPIKE_COLUMNS)


def _long_spikes(name: str, profile: Profile, scale: Scale = Scale()) -> None:
    @query(name, o.base(profile).long_spikes().despike().select(o.shown(SPIKE_COLUMNS)))
    def run(spark, sf):
        df = with_long_spikes(readings(spark, sf))
        return show(m.remove_spikes(df, profile=profile, scale=scale), SPIKE_COLUMNS)


_long_spikes("long_spikes", EFFECTIVE)
_long_spikes("long_spikes_fixpoint", DOCUMENTED)
_long_spikes("long_spikes_split_meters", EFFECTIVE, SPLIT)
_long_spikes("long_spikes_fixpoint_split_meters", DOCUMENTED, SPLIT)


def _loads(spark, sf):
    frame = Frame.split(clean(spark, sf), Scale())
    return frame.map(lambda df, layout: add_loads(df, layout, Params(), EFFECTIVE)).union()


DIFF_COLUMNS = ["meter_number", "id", "timestamp", "diff_prev_timestamp", "diff_next_timestamp"]
LOAD_COLUMNS = ["meter_number", "id", "timestamp", "load"]


@query("neighbour_diffs", o.clean().loads().select(o.shown(DIFF_COLUMNS)))
def neighbour_diffs(spark, sf):
    return show(_loads(spark, sf), DIFF_COLUMNS)


@query("load_flags", o.clean().loads().select(o.shown(LOAD_COLUMNS)))
def load_flags(spark, sf):
    return show(_loads(spark, sf), LOAD_COLUMNS)


LATEST_COLUMNS = ["meter_number", "id", "timestamp", "load_count", "timestamp_load"]
PER_METER = replace(EFFECTIVE, loads_cross_meters=False)


@query("latest_load_global", o.clean().loads().select(o.shown(LATEST_COLUMNS)))
def latest_load_global(spark, sf):
    return show(m.event_conditions(clean(spark, sf)), LATEST_COLUMNS)


@query("latest_load_per_meter", o.clean(PER_METER).loads().select(o.shown(LATEST_COLUMNS)))
def latest_load_per_meter(spark, sf):
    return show(m.event_conditions(clean(spark, sf), profile=PER_METER), LATEST_COLUMNS)


@query("rule_starts_ends", o.clean().loads().rules().select(o.shown(o.FLAG_COLUMNS)))
def rule_starts_ends(spark, sf):
    return show(m.event_conditions(clean(spark, sf)), o.FLAG_COLUMNS)


@query(
    "rule_starts_ends_documented",
    o.clean(DOCUMENTED).loads().rules().select(o.shown(o.FLAG_COLUMNS)),
)
def rule_starts_ends_documented(spark, sf):
    df = m.event_conditions(clean(spark, sf, DOCUMENTED), profile=DOCUMENTED)
    return show(df, o.FLAG_COLUMNS)


# -- sessions ------------------------------------------------------------------------------------

ID_COLUMNS = ["meter_number", "id", "timestamp", "event_id"]


@query(
    "event_ids_global",
    o.clean()
    .sessions()
    .add(event_id="CAST(sum(cooking_start::INT) OVER fr AS BIGINT)")
    .select(o.shown(ID_COLUMNS)),
)
def event_ids_global(spark, sf):
    frame = Frame.split(clean(spark, sf), Scale())
    df = session_frame(frame, Params(), EFFECTIVE, keep=True).union()
    return show(df.withColumnRenamed(RAW_EVENT, "event_id"), ID_COLUMNS)


BOUND_COLUMNS = ["meter_number", "id", "timestamp", "time_start", "energy_start", "time_end", "energy_end"]


@query("event_bounds_effective", o.clean().sessions().select(o.shown(BOUND_COLUMNS)))
def event_bounds_effective(spark, sf):
    return show(sessions(spark, sf), BOUND_COLUMNS)


@query("event_bounds_documented", o.clean(FIRST_FLAG).sessions().select(o.shown(BOUND_COLUMNS)))
def event_bounds_documented(spark, sf):
    return show(sessions(spark, sf, FIRST_FLAG), BOUND_COLUMNS)


@query(
    "disqualified_events",
    o.clean().sessions().select(o.shown(o.SESSION_COLUMNS), "WHERE cooking_event IS NULL"),
)
def disqualified_events(spark, sf):
    return show(sessions(spark, sf).filter("cooking_event IS NULL"), o.SESSION_COLUMNS)


@query("sessions", o.clean().sessions().select(o.shown(o.SESSION_COLUMNS)))
def sessions_effective(spark, sf):
    return show(sessions(spark, sf), o.SESSION_COLUMNS)


@query("sessions_documented", o.clean(DOCUMENTED).sessions().select(o.shown(o.SESSION_COLUMNS)))
def sessions_documented(spark, sf):
    return show(sessions(spark, sf, DOCUMENTED), o.SESSION_COLUMNS)


@query("sessions_split_meters", o.clean().sessions().select(o.shown(o.SESSION_COLUMNS)))
def sessions_split_meters(spark, sf):
    return show(m.cooking_event(clean(spark, sf), scale=SPLIT), o.SESSION_COLUMNS)


# -- duplicates and extension --------------------------------------------------------------------

ISSUE_COLUMNS = o.SESSION_COLUMNS + ["timestamp_issue"]


def _duplicates(name: str, profile: Profile) -> None:
    sql = (
        o.clean(profile, whole_seconds=True)
        .sessions()
        .flag_duplicates()
        .drop_duplicates()
        .select(o.shown(ISSUE_COLUMNS))
    )

    @query(name, sql)
    def run(spark, sf):
        df = sessions(spark, sf, profile, whole_seconds=True)
        return show(m.timestamp_issue(df, profile=profile), ISSUE_COLUMNS)


_duplicates("duplicate_events_label", EFFECTIVE)
_duplicates("duplicate_events_row", DOCUMENTED)


def _extension(suffix: str, profile: Profile) -> None:
    def source() -> o.Query:
        return o.clean(profile).sessions()

    @query(f"extend_ending{suffix}", source().extend_ending().select(o.shown(o.END_COLUMNS)))
    def ending(spark, sf):
        return show(m.addtoevent_ending(sessions(spark, sf, profile), profile=profile), o.END_COLUMNS)

    columns = o.SESSION_COLUMNS + ["energy_gap_to_prev", "start_added"]

    @query(f"extend_beginning{suffix}", source().extend_beginning().select(o.shown(columns)))
    def beginning(spark, sf):
        return show(m.addtoevent_beginning(sessions(spark, sf, profile), profile=profile), columns)


_extension("", EFFECTIVE)
_extension("_documented", DOCUMENTED)

RESIDUAL_COLUMNS = o.BOTH_COLUMNS + ["energy_gap_time"]


@query(
    "residual_minutes",
    o.clean(NOTEBOOK).sessions().extend_ending().extend_beginning().select(o.shown(RESIDUAL_COLUMNS)),
)
def residual_minutes(spark, sf):
    df = m.addtoevent_ending(sessions(spark, sf), profile=NOTEBOOK)
    return show(m.addtoevent_beginning(df, profile=NOTEBOOK), RESIDUAL_COLUMNS)


def _second_pass(suffix: str, profile: Profile) -> None:
    columns = o.SESSION_COLUMNS + ["end_added", "start_added"]

    @query(
        f"second_pass_sessions{suffix}",
        o.extended(profile).sessions(second=True).select(o.shown(columns)),
    )
    def run(spark, sf):
        return show(m.session_pipeline(readings(spark, sf), profile=profile), columns)


_second_pass("", EFFECTIVE)
_second_pass("_documented", DOCUMENTED)


# -- replayed events ------------------------------------------------------------------------------

FEW = Scale(scan_rows=10)  # so that flagged times go into bitmaps, and meters into blocks
WIDE = Params(power_capacity=1.5, time_resolution=10)  # other than the values that the fixed steps assume


def _replayed(profile: Profile = EFFECTIVE, params: Params = Params(), **kw) -> o.Query:
    return o.base(profile, params, **kw).replays().despike().zone()


def _replayed_duplicates(name: str, profile: Profile, scale: Scale = Scale(), **kw) -> None:
    sql = _replayed(profile, **kw).sessions().flag_duplicates().drop_duplicates().select(o.shown(ISSUE_COLUMNS))

    @query(name, sql)
    def run(spark, sf):
        df = m.remove_spikes(replayed(readings(spark, sf, scale, **kw)), profile=profile, scale=scale)
        df = m.cooking_event(df, profile=profile, scale=scale)
        return show(m.timestamp_issue(df, profile=profile, scale=scale), ISSUE_COLUMNS)


_replayed_duplicates("duplicate_replays_label", EFFECTIVE)
_replayed_duplicates("duplicate_replays_label_bitmap", EFFECTIVE, FEW)
_replayed_duplicates("duplicate_replays_label_seconds", EFFECTIVE, FEW, whole_seconds=True)
_replayed_duplicates("duplicate_replays_row", DOCUMENTED)
_replayed_duplicates("duplicate_replays_last_row", replace(DOCUMENTED, check_last_rows_only=True))
_replayed_duplicates("duplicate_replays_split_meters", EFFECTIVE, SPLIT)


def _replayed_pipeline(name: str, profile: Profile, params: Params = Params(), scale: Scale = Scale()) -> None:
    sql = (
        _replayed(profile, params).sessions().flag_duplicates().drop_duplicates().extend_ending().extend_beginning()
        .sessions(second=True).event_table().select(o.shown(o.EVENT_COLUMNS))
    )

    @query(name, sql)
    def run(spark, sf):
        df = replayed(readings(spark, sf, scale))
        return show(m.event_pipeline(df, params, profile, scale, whole_time=True), o.EVENT_COLUMNS)


_replayed_pipeline("full_pipeline_replays", EFFECTIVE)
_replayed_pipeline("full_pipeline_replays_documented", DOCUMENTED)
_replayed_pipeline("full_pipeline_replays_split_meters", EFFECTIVE, scale=SPLIT)
_replayed_pipeline("full_pipeline_replays_capacity", EFFECTIVE, WIDE)
_replayed_pipeline("full_pipeline_replays_capacity_documented", DOCUMENTED, WIDE)


@query(
    "definition_variant_replays",
    _replayed(DEFINITION_PROFILE, DEFINITION_PARAMS).sessions().flag_duplicates().drop_duplicates()
    .event_table().select(o.shown(o.EVENT_COLUMNS)),
)
def definition_variant_replays(spark, sf):
    return show(m.definition_pipeline(replayed(readings(spark, sf))), o.EVENT_COLUMNS)


# -- readings without a meter number ---------------------------------------------------------------


def _meterless(spark, sf, scale: Scale = Scale()) -> DataFrame:
    """Every fiftieth reading has lost its meter number."""
    kept = F.when(F.col("id") % 50 != 0, F.col("meter_number"))
    return readings(spark, sf, scale).withColumn("meter_number", kept)


def _meterless_queries(suffix: str, profile: Profile, scale: Scale = Scale()) -> None:
    def source() -> o.Query:
        return o.base(profile).lose_meters().despike().zone()

    @query(f"remove_spikes_null_meter{suffix}", source().select(o.shown(SPIKE_COLUMNS)))
    def spikes(spark, sf):
        return show(m.remove_spikes(_meterless(spark, sf, scale), profile=profile, scale=scale), SPIKE_COLUMNS)

    @query(f"sessions_null_meter{suffix}", source().sessions().select(o.shown(o.SESSION_COLUMNS)))
    def found(spark, sf):
        df = m.remove_spikes(_meterless(spark, sf, scale), profile=profile, scale=scale)
        return show(m.cooking_event(df, profile=profile, scale=scale), o.SESSION_COLUMNS)

    sql = (
        source().sessions().flag_duplicates().drop_duplicates().extend_ending().extend_beginning()
        .sessions(second=True).event_table().select(o.shown(o.EVENT_COLUMNS))
    )

    @query(f"full_pipeline_null_meter{suffix}", sql)
    def whole(spark, sf):
        df = m.event_pipeline(_meterless(spark, sf, scale), profile=profile, scale=scale, whole_time=True)
        return show(df, o.EVENT_COLUMNS)


_meterless_queries("", EFFECTIVE)
_meterless_queries("_documented", DOCUMENTED)
_meterless_queries("_split_meters", EFFECTIVE, SPLIT)

# -- chained operators --------------------------------------------------------------------------------


def _chain_queries(suffix: str, profile: Profile, scale: Scale = Scale()) -> None:
    def source() -> o.Query:
        return _replayed(profile).sessions().flag_duplicates().drop_duplicates()

    def started(spark, sf) -> m.Chain:
        df = replayed(readings(spark, sf, scale))
        return m.chain(df, profile=profile, scale=scale).remove_spikes().cooking_event().timestamp_issue()

    @query(f"chained_duplicates{suffix}", source().select(o.shown(o.SESSION_COLUMNS)))
    def rows(spark, sf):
        return show(started(spark, sf).readings(), o.SESSION_COLUMNS)

    sql = source().extend_ending().extend_beginning().sessions(second=True).event_table().select(o.shown(o.EVENT_COLUMNS))

    @query(f"chained_pipeline{suffix}", sql)
    def events(spark, sf):
        done = started(spark, sf).addtoevent_ending().addtoevent_beginning().cooking_event()
        return show(done.only_events(), o.EVENT_COLUMNS)


_chain_queries("", EFFECTIVE)
_chain_queries("_documented", DOCUMENTED)
_chain_queries("_split_meters", EFFECTIVE, SPLIT)

# -- readings that share meter, time and id ---------------------------------------------------------


def _sent_twice_queries(suffix: str, profile: Profile, scale: Scale = Scale()) -> None:
    def source() -> o.Query:
        return o.base(profile).sent_twice().despike().zone().sessions()

    def twice(spark, sf) -> DataFrame:
        df = readings(spark, sf, scale)
        return df.unionByName(df.filter(F.col("id") % 10 == 0))

    @query(f"sessions_repeated_rows{suffix}", source().select(o.shown(o.SESSION_COLUMNS)))
    def found(spark, sf):
        df = m.remove_spikes(twice(spark, sf), profile=profile, scale=scale)
        return show(m.cooking_event(df, profile=profile, scale=scale), o.SESSION_COLUMNS)

    sql = source().flag_duplicates().drop_duplicates().event_table().select(o.shown(o.EVENT_COLUMNS))

    @query(f"events_repeated_rows{suffix}", sql)
    def summed(spark, sf):
        df = m.cooking_event(m.remove_spikes(twice(spark, sf), profile=profile, scale=scale), profile=profile, scale=scale)
        df = m.timestamp_issue(df, profile=profile, scale=scale)
        return show(m.only_events(df, profile=profile, scale=scale), o.EVENT_COLUMNS)


_sent_twice_queries("", EFFECTIVE)
_sent_twice_queries("_documented", DOCUMENTED)
_sent_twice_queries("_split_meters", EFFECTIVE, SPLIT)

# -- event table and pipelines -------------------------------------------------------------------


@query("event_summary", o.clean().sessions().event_table().select(o.shown(o.EVENT_COLUMNS)))
def event_summary(spark, sf):
    return show(m.only_events(sessions(spark, sf)), o.EVENT_COLUMNS)


COST_COLUMNS = ["meter_number", "cooking_event", "energy_gen", "power_mean", "cooking_cost"]


@query(
    "event_cost",
    o.clean(params=Params(tzs_per_kwh=356.5)).sessions().event_table().select(o.shown(COST_COLUMNS)),
)
def event_cost(spark, sf):
    events = event_energy(sessions(spark, sf))
    return show(add_cost(events, Params(tzs_per_kwh=356.5)), COST_COLUMNS)


def _pipeline(name: str, profile: Profile, scale: Scale = Scale()) -> None:
    sql = (
        o.extended(profile)
        .sessions(second=True)
        .event_table()
        .period(DAY.period_start, DAY.period_end)
        .select(o.shown(o.EVENT_COLUMNS))
    )

    @query(name, sql)
    def run(spark, sf):
        df = m.event_pipeline(readings(spark, sf, scale), DAY, profile, scale)
        return show(df, o.EVENT_COLUMNS)


_pipeline("full_pipeline", EFFECTIVE)
_pipeline("full_pipeline_documented", DOCUMENTED)
_pipeline("full_pipeline_split_meters", EFFECTIVE, SPLIT)
_pipeline("full_pipeline_documented_split_meters", DOCUMENTED, SPLIT)


@query(
    "notebook_pipeline",
    o.extended()
    .event_table()
    .period(DAY.period_start, DAY.period_end)
    .select(o.shown(o.EVENT_COLUMNS)),
)
def notebook_pipeline(spark, sf):
    return show(m.notebook_pipeline(readings(spark, sf), DAY), o.EVENT_COLUMNS)


@query(
    "notebook_resession",
    o.extended(replace(EFFECTIVE, keep_stale_columns=False))
    .sessions(second=True)
    .select(o.shown(o.SESSION_COLUMNS)),
)
def notebook_resession(spark, sf):
    df = for_resession(extended_sessions(readings(spark, sf)))
    return show(m.cooking_event(df), o.SESSION_COLUMNS)


def _definition() -> o.Query:
    q = o.clean(DEFINITION_PROFILE, DEFINITION_PARAMS).sessions()
    return q.flag_duplicates().drop_duplicates()


@query("definition_sessions", _definition().select(o.shown(o.SESSION_COLUMNS)))
def definition_variant_sessions(spark, sf):
    return show(definition_sessions(readings(spark, sf)), o.SESSION_COLUMNS)


@query("definition_variant", _definition().event_table().select(o.shown(o.EVENT_COLUMNS)))
def definition_variant(spark, sf):
    return show(m.definition_pipeline(readings(spark, sf)), o.EVENT_COLUMNS)


# -- reports -------------------------------------------------------------------------------------

NEXT_GAP = (
    "CASE WHEN cooking_event IS NOT NULL AND coalesce(cooking_event <> lead(cooking_event) OVER f, "
    "true) AND lead(meter_number) OVER f = meter_number THEN lead(energy) OVER f - energy END"
)
GAP_COLUMNS = o.BOTH_COLUMNS + ["gaps_to_next_server_issue"]


@query(
    "residual_gaps",
    o.extended().add(gaps_to_next_server_issue=NEXT_GAP).select(o.shown(GAP_COLUMNS)),
)
def residual_gaps(spark, sf):
    return show(m.gaps_to_next(extended_sessions(readings(spark, sf))), GAP_COLUMNS)


@query(
    "gap_energy_total",
    o.clean()
    .sessions()
    .extend_ending()
    .step("sum(energy_gap_to_next) AS energy_gap_total", window="WHERE energy_gap_to_next > 0")
    .select(o.shown(["energy_gap_total"])),
)
def gap_energy_total(spark, sf):
    df = m.addtoevent_ending(sessions(spark, sf))
    return show(m.gap_energy_total(df), ["energy_gap_total"])


@query(
    "distinct_events",
    o.extended().select("count(DISTINCT cooking_event) AS events"),
)
def distinct_event_count(spark, sf):
    return distinct_events(extended_sessions(readings(spark, sf)))


REPORT_COLUMNS = o.BOTH_COLUMNS
BOTH = ", ".join(["meter_number", *o.BOTH_ORDER])


@query(
    "top20_longest",
    o.extended().select(
        o.shown(REPORT_COLUMNS),
        "ORDER BY t1.cooking_time DESC NULLS LAST, t1.timestamp, t1.meter_number, t1.start_added, "
        "t1.end_added, t1.id LIMIT 20".replace("t1", o.extended().last),
    ),
)
def top20_longest(spark, sf):
    ties = ["timestamp", "meter_number", "start_added", "end_added", "id"]
    return show(longest(extended_sessions(readings(spark, sf)), ties), REPORT_COLUMNS)


@query("first20", o.clean().sessions().select(o.shown(o.SESSION_COLUMNS), "ORDER BY meter_number, timestamp, id LIMIT 20"))
def first20(spark, sf):
    df = sessions(spark, sf)
    return show(first_rows(df, ["meter_number", *row_order(df)]), o.SESSION_COLUMNS)


@query("tail60", o.clean().sessions().select(o.shown(o.SESSION_COLUMNS), "ORDER BY meter_number DESC, timestamp DESC, id DESC LIMIT 60"))
def tail60(spark, sf):
    df = sessions(spark, sf)
    return show(last_rows(df, ["meter_number", *row_order(df)]), o.SESSION_COLUMNS)


EXPORT_COLUMNS = [
    c for c in o.SESSION_COLUMNS
    if c not in ("meter_number", "load", "load_count", "timestamp_load",
                 "diff_prev_timestamp", "diff_next_timestamp")
]


@query("export_order", o.clean().sessions().select(o.shown(EXPORT_COLUMNS)))
def export_order(spark, sf):
    return show(for_export(sessions(spark, sf)), EXPORT_COLUMNS)


@query(
    "union_missing_columns",
    "WITH r AS (" + o.base().select(o.shown(o.RAW_COLUMNS)) + ") "
    "SELECT meter_number, id, timestamp, energy, power, voltage FROM r UNION ALL "
    "SELECT meter_number, id, timestamp, energy, NULL, NULL FROM r",
)
def union_missing_columns(spark, sf):
    df = show(readings(spark, sf), o.RAW_COLUMNS)
    left = df.select("meter_number", "id", "timestamp", "energy", "power", "voltage")
    return left.unionByName(left.drop("power", "voltage"), allowMissingColumns=True)

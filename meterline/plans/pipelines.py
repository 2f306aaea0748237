"""From raw readings to sessions and event tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from meterline.operators.despike import despike_frame
from meterline.operators.duplicates import drop_frame, flag_frame
from meterline.operators.extend import extend_beginning_frame, extend_ending_frame
from meterline.operators.sessions import RAW_EVENT, metered, prepare, session_frame, with_unmetered
from meterline.operators.slices import period
from meterline.operators.summary import event_table, only_events
from meterline.operators.timeline import Frame
from meterline.params import EFFECTIVE, Params, Profile, Scale

# The older definition of events: readings always move to local time, the meter's first row is
# not forced to start an event, and events need twice the mean power.
DEFINITION_PROFILE = replace(
    EFFECTIVE, zone_match="always", prev_diff_needs_next_row=True, force_start_at_meter=False
)
DEFINITION_PARAMS = Params(power_mean_min=0.1)


def _clean_frame(readings: DataFrame, params: Params, profile: Profile, scale: Scale) -> Frame:
    """Spikes repaired; the zone shift moves all rows alike, so it may come first."""
    return despike_frame(Frame.split(prepare(readings, profile), scale), params, profile)


def _extended(frame: Frame, params: Params, profile: Profile, numbered: bool) -> Frame:
    frame = session_frame(frame, params, profile, numbered=numbered, keep=True)
    frame = drop_frame(flag_frame(frame, params, profile), profile)
    if profile.drop_by_timestamp:  # the rows were stored
        frame = frame.dealt()
    frame = extend_ending_frame(frame, params, profile)
    frame = extend_beginning_frame(frame, params, profile)
    return frame.map(lambda df, _: df.drop(RAW_EVENT))


def extended_sessions(
    readings: DataFrame,
    params: Params = Params(),
    profile: Profile = EFFECTIVE,
    scale: Scale = Scale(),
) -> DataFrame:
    """Sessions after duplicate removal and extension at both ends, in one pass."""
    frame = _clean_frame(readings, params, profile, scale)
    return _extended(frame, params, profile, numbered=True).union()


def session_pipeline(
    readings: DataFrame,
    params: Params = Params(),
    profile: Profile = EFFECTIVE,
    scale: Scale = Scale(),
) -> DataFrame:
    """Sessions of the extended readings, found in a second pass."""
    frame = _clean_frame(readings, params, profile, scale)
    frame = _extended(frame, params, profile, numbered=False)
    return session_frame(frame, params, profile).union()


def event_pipeline(
    readings: DataFrame,
    params: Params = Params(),
    profile: Profile = EFFECTIVE,
    scale: Scale = Scale(),
    whole_time: bool = False,
) -> DataFrame:
    """The event table of the second pass, cut to the period unless ``whole_time``."""
    frame = _clean_frame(readings, params, profile, scale)
    frame = _extended(frame, params, profile, numbered=False)
    frame = session_frame(frame, params, profile, numbered=False, keep=True)
    events = event_table(frame, params, profile)
    if whole_time:
        return events
    return period(events, params.period_start, params.period_end, profile)


def notebook_pipeline(
    readings: DataFrame,
    params: Params = Params(),
    profile: Profile = EFFECTIVE,
    scale: Scale = Scale(),
    whole_time: bool = False,
) -> DataFrame:
    """The event table of the extended sessions without a second pass."""
    events = only_events(extended_sessions(readings, params, profile, scale), params, profile, scale)
    if whole_time:
        return events
    return period(events, params.period_start, params.period_end, profile)


def definition_sessions(
    readings: DataFrame,
    params: Params = DEFINITION_PARAMS,
    profile: Profile = DEFINITION_PROFILE,
    scale: Scale = Scale(),
) -> DataFrame:
    """Sessions by the older definition, in which an event may run on into the next meter."""
    frame = Frame.stacked(_clean_frame(metered(readings), params, profile, scale).union(), scale)
    frame = session_frame(frame, params, profile)
    done = drop_frame(flag_frame(frame, params, profile), profile).union()
    return with_unmetered(done, prepare(readings, profile))


def definition_pipeline(
    readings: DataFrame,
    params: Params = DEFINITION_PARAMS,
    profile: Profile = DEFINITION_PROFILE,
    scale: Scale = Scale(),
) -> DataFrame:
    """The event table by the older definition."""
    sessions = definition_sessions(readings, params, profile, scale)
    return only_events(sessions, params, profile, scale, shared_numbers=True)


"""Operators one after the other over readings that are counted, split and shuffled once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from meterline.operators.despike import despike_frame
from meterline.operators.duplicates import drop_frame, flag_frame
from meterline.operators.extend import extend_beginning_frame, extend_ending_frame
from meterline.operators.sessions import HELPERS, RAW_EVENT, meter_starts, number_events, prepare, session_frame
from meterline.operators.summary import event_table, only_events
from meterline.operators.timeline import Frame
from meterline.params import EFFECTIVE, Params, Profile, Scale


@dataclass(frozen=True)
class Chain:
    """The public operators as methods; each returns a longer chain.

    The partitioning by meter, the strips of heavy meters and the row order are handed on from step to
    step, where the plain functions find them anew. The zone shift comes first, since it moves
    all rows alike. Event numbers stay within the meter until rows or events are asked for.
    """

    frame: Frame
    params: Params
    profile: Profile
    starts: DataFrame | None = None  # events of each meter in the latest numbering
    fresh: bool = False  # no row has come or gone since

    def _next(self, frame: Frame) -> Chain:
        return replace(self, frame=frame, fresh=False)

    def _sessions(self) -> Frame:
        if self.starts is None:
            raise ValueError("cooking_event must come before this step")
        return self.frame

    def remove_spikes(self) -> Chain:
        return self._next(despike_frame(self.frame, self.params, self.profile))

    def cooking_event(self) -> Chain:
        bare = self.frame.map(lambda df, _: df.drop(RAW_EVENT)).arrange()
        frame = session_frame(bare, self.params, self.profile, numbered=False, keep=True)
        return replace(self, frame=frame, starts=meter_starts(frame), fresh=True)

    def timestamp_issue(self) -> Chain:
        frame = drop_frame(flag_frame(self._sessions(), self.params, self.profile), self.profile)
        return self._next(frame.dealt() if self.profile.drop_by_timestamp else frame)

    def addtoevent_ending(self) -> Chain:
        return self._next(extend_ending_frame(self._sessions(), self.params, self.profile))

    def addtoevent_beginning(self) -> Chain:
        return self._next(extend_beginning_frame(self._sessions(), self.params, self.profile))

    def readings(self) -> DataFrame:
        """The rows as they are now, events numbered over the whole frame."""
        frame = self.frame if self.starts is None else number_events(self.frame, self.starts)
        return frame.map(lambda df, _: df.drop(*HELPERS)).union()

    def only_events(self) -> DataFrame:
        """The event table of the rows as they are now."""
        if self.fresh:
            return event_table(self._sessions(), self.params, self.profile)
        return only_events(self.readings(), self.params, self.profile, self.frame.scale)


def chain(
    readings: DataFrame,
    params: Params = Params(),
    profile: Profile = EFFECTIVE,
    scale: Scale = Scale(),
) -> Chain:
    """Start a chain of operators over raw readings."""
    return Chain(Frame.split(prepare(readings, profile), scale), params, profile)

"""Meter session analytics on PySpark.

Every operator takes and returns a DataFrame. Building one runs jobs where rows are counted or written
once for several readers; nothing is collected except bounded summaries, named where they occur.
"""

from meterline.operators.despike import remove_spikes
from meterline.operators.duplicates import timestamp_issue
from meterline.operators.extend import addtoevent_beginning, addtoevent_ending, residual_minutes
from meterline.operators.gaps import gap_energy_total, gaps_to_next
from meterline.operators.pinning import release
from meterline.operators.sessions import cooking_event, event_conditions
from meterline.operators.slices import period
from meterline.operators.summary import only_events
from meterline.params import DOCUMENTED, EFFECTIVE, NOTEBOOK, Params, Profile, Scale
from meterline.plans.chain import Chain, chain
from meterline.plans.pipelines import (
    definition_pipeline,
    event_pipeline,
    notebook_pipeline,
    session_pipeline,
)

__all__ = [
    "Chain",
    "DOCUMENTED",
    "EFFECTIVE",
    "NOTEBOOK",
    "Params",
    "Profile",
    "Scale",
    "addtoevent_beginning",
    "addtoevent_ending",
    "chain",
    "cooking_event",
    "definition_pipeline",
    "event_conditions",
    "event_pipeline",
    "gap_energy_total",
    "gaps_to_next",
    "notebook_pipeline",
    "only_events",
    "period",
    "release",
    "remove_spikes",
    "residual_minutes",
    "session_pipeline",
    "timestamp_issue",
]

"""Queries against their SQL on the smallest tables; ``verification.check`` runs all of them."""

import os

from dataclasses import replace

import pytest

from meterline.params import DOCUMENTED, EFFECTIVE, Params
from verification import oracle as o
from verification.check import compare, connect
from verification.queries import QUERIES, WIDE

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = [
    "csv_roundtrip",
    "csv_mixed_headers",
    "ordered_files",
    "period_files_shifted",
    "period_slice",
    "remove_spikes",
    "remove_spikes_split_meters",
    "long_spikes_fixpoint",
    "sessions_null_meter",
    "duplicate_replays_label_bitmap",
    "full_pipeline_replays_capacity",
    "sessions",
    "sessions_repeated_rows",
    "events_repeated_rows_documented",
    "chained_duplicates",
    "chained_pipeline_documented",
    "duplicate_events_label",
    "residual_minutes",
    "full_pipeline",
    "full_pipeline_documented",
    "definition_variant",
    "top20_longest",
]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables are not here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, name).startswith("ok")


def _rows(con, query, columns="*"):
    return sorted(map(repr, con.execute(query.select(columns)).fetchall()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="tables are not here")
def test_the_readings_tell_the_settings_apart():
    """Replays are flagged, and what each switch does shows in the rows that the queries compare."""
    con = connect("/root/testdata/sf0.01")

    def replays(profile=EFFECTIVE, params=Params(), **kw):
        return o.base(profile, params, **kw).replays().despike().zone().sessions().flag_duplicates()

    for profile in (EFFECTIVE, DOCUMENTED):
        flagged, rows = con.execute(replays(profile).select("count(timestamp_issue), count(*)")).fetchone()
        assert flagged >= 0.01 * rows
    pairs = {
        "drop_by_timestamp": lambda p: replays(p, whole_seconds=True).drop_duplicates(),
        "check_last_rows_only": lambda p: replays(p).drop_duplicates(),
        "fixed_extension_energy": lambda p: replays(p, WIDE).extend_ending(),
        "spikes_to_fixpoint": lambda p: o.base(p).long_spikes().despike(),
    }
    shown = "meter_number, id, timestamp, energy"
    for switch, query in pairs.items():
        base = replace(EFFECTIVE, drop_by_timestamp=False) if switch == "check_last_rows_only" else EFFECTIVE
        other = replace(base, **{switch: not getattr(base, switch)})
        assert _rows(con, query(base), shown) != _rows(con, query(other), shown), switch


def test_every_query_has_sql():
    assert all(callable(fn) and sql for fn, sql in QUERIES.values())

"""Readings without a meter number stay, without an event; heavy meters keep to their strips."""

import pytest

import meterline as m
from meterline.operators.gaps import gap_energy_total
from meterline.params import DOCUMENTED, EFFECTIVE, Scale
from meterline.operators.timeline import Frame
from pyspark.sql import functions as F
from tests.helpers import IDLE_TAIL, TWO_SESSIONS, at, readings, rows_of

MIXED = [*TWO_SESSIONS, (None, "0:07", 3.0, 0.4), (None, "0:09", 9.0, 0.4), (None, "0:09", 9.0, 0.4)]


@pytest.mark.parametrize("profile", [EFFECTIVE, DOCUMENTED], ids=["effective", "documented"])
@pytest.mark.parametrize("scale", [Scale(), Scale(hot_meter_rows=3, strip_rows=101)], ids=["plain", "split"])
def test_no_row_is_lost(spark, profile, scale):
    df = readings(spark, MIXED)
    assert m.remove_spikes(df, profile=profile, scale=scale).count() == len(MIXED)
    assert m.event_conditions(df, profile=profile, scale=scale).count() == len(MIXED)
    done = m.cooking_event(df, profile=profile, scale=scale)
    lost = done.filter("meter_number IS NULL")
    assert rows_of(lost, "cooking_start", "cooking_end", "cooking_event", "cooking_time") == [(True, False, None, None)] * 3
    own = m.cooking_event(readings(spark, TWO_SESSIONS), profile=profile, scale=scale)
    shown = ("cooking_start", "cooking_end", "cooking_event", "time_end", "energy_start")
    got, want = rows_of(done.filter("meter_number IS NOT NULL"), *shown), rows_of(own, *shown)
    if profile is EFFECTIVE:
        # Only the very last reading of all is left open, and that is one without a meter number now.
        assert got[-1][1] and not want[-1][1]
        got[-1], want[-1] = got[-1][:1], want[-1][:1]
    assert got == want


@pytest.mark.parametrize("profile", [EFFECTIVE, DOCUMENTED], ids=["effective", "documented"])
@pytest.mark.parametrize("scale", [Scale(), Scale(hot_meter_rows=3, strip_rows=101, scan_rows=1)], ids=["plain", "split"])
def test_rows_without_a_meter_are_no_neighbours(spark, profile, scale):
    rows = [(None, f"0:{i:02d}", e, 0.0) for i, e in enumerate([9.0, 3.0, 3.5, 1.0, None, 0.5])]
    df = readings(spark, [*rows, *TWO_SESSIONS])
    left = m.remove_spikes(df, profile=profile, scale=scale).filter("meter_number IS NULL")
    assert rows_of(left, "energy") == [(9.0,), (3.0,), (3.5,), (1.0,), (None,), (0.5,)]
    done = m.cooking_event(df, profile=profile, scale=scale).filter("meter_number IS NULL")
    last = [t for _, t, *_ in TWO_SESSIONS][-1]
    loads = 4 if profile is EFFECTIVE else 0  # the frame's running count, or the row's own
    shown = rows_of(done, "load", "load_count", "cooking_start", "cooking_end", "diff_prev_timestamp")
    assert shown == [(None, shown[0][1], True, False, None)] * 6 and (loads == 0) == (shown[0][1] == 0)
    times = {t for (t,) in rows_of(done, "timestamp_load")}
    assert times == ({at(last)} if profile is EFFECTIVE else {at(f"0:0{i}") for i in range(6)})


def test_rows_without_a_meter_spread_over_tasks(spark):
    """They are partitioned one by one, so no task gathers them."""
    rows = [(None, "0:00", float(i), 0.0) for i in range(400)]
    frame = Frame.split(readings(spark, rows), Scale(hot_meter_rows=3, strip_rows=101))
    assert len(frame.parts) == 1
    part = frame.parts[0]
    dealt = part.df.repartition(8, *part.layout.keys).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 120 and len(dealt) == 8


def test_only_rows_without_a_meter(spark):
    df = readings(spark, [(None, "0:00", 9.0, 0.9), (None, "0:05", 1.0, 0.9)])
    assert m.session_pipeline(df).count() == 2 and m.event_pipeline(df, whole_time=True).count() == 0


def test_heavy_meters_are_not_shuffled_by_number(spark):
    """With more meters than a broadcast may hold, only the ordinary part is joined by meter."""
    rows = [*TWO_SESSIONS, *[(9, *row[1:]) for row in IDLE_TAIL[:2]]]
    scale = Scale(hot_meter_rows=3, strip_rows=101, scan_rows=1)
    got = m.cooking_event(readings(spark, rows), scale=scale)
    want = m.cooking_event(readings(spark, rows))
    shown = ("cooking_start", "cooking_end", "cooking_event", "time_start", "energy_end")
    assert rows_of(got, *shown) == rows_of(want, *shown)


def test_added_rows_do_not_repeat_a_gap(spark):
    df = spark.createDataFrame(
        [(0.04, 0), (0.04, 1), (None, 0)], "energy_gap_to_next double, end_added int"
    )
    assert gap_energy_total(df).first()[0] == 0.04


def test_files_with_other_column_orders_are_refused(spark, tmp_path):
    from meterline.sources.files import read_csv

    (tmp_path / "a.csv").write_text("meter_number,energy,power\n1,0.5,0.2\n")
    (tmp_path / "b.csv").write_text("meter_number,power,energy\n1,0.2,0.5\n")
    with pytest.raises(Exception, match="header|Header|CSV"):
        read_csv(spark, str(tmp_path)).collect()


def test_pinned_tables_can_be_released(spark):
    from meterline.operators.pinning import pin, release

    release(spark)
    table = pin(spark.range(5))
    assert table.count() == 5 and release(spark) == 1 and release(spark) == 0
    with pytest.raises(Exception):
        table.collect()

from datetime import timedelta

import pytest

import meterline as m
from meterline.params import DOCUMENTED, EFFECTIVE
from tests.helpers import SPLIT, TWO_SESSIONS, at, readings, rows_of
from pyspark.sql import functions as F


def labelled(df, events):
    """Readings with an event number per row and bounds taken from the rows themselves."""
    number = F.element_at(F.array(*[F.lit(e).cast("bigint") for e in events]), F.col("id").cast("int"))
    return df.withColumns(
        {
            "cooking_event": number,
            "time_start": F.col("timestamp"),
            "time_end": F.col("timestamp"),
            "energy_start": F.col("energy"),
            "energy_end": F.col("energy"),
            "cooking_time": F.when(number.isNotNull(), F.lit(10.0)),
            "seq_time": F.when(number.isNotNull(), F.lit(10.0)),
        }
    )


def test_repeated_event_is_dropped(spark):
    rows = [
        (1, "0:00", 10.00, 0.9), (1, "0:05", 10.10, 0.9),
        (1, "1:00", 10.05, 0.9), (1, "1:05", 10.12, 0.9),
        (1, "2:00", 10.20, 0.9), (1, "2:05", 10.30, 0.9),
        (2, "1:05", 3.00, 0.9), (2, "1:10", 3.10, 0.9),
    ]
    df = labelled(readings(spark, rows), [1, 1, 2, 2, 3, 3, 4, 4])
    for scale in (m.Scale(), SPLIT):
        kept = rows_of(m.timestamp_issue(df, scale=scale), "meter_number", "id")
        assert kept == [(1, 1), (1, 2), (1, 5), (1, 6), (2, 8)]
        kept = rows_of(m.timestamp_issue(df, profile=DOCUMENTED, scale=scale), "meter_number", "id")
        assert kept == [(1, 1), (1, 2), (1, 5), (1, 6), (2, 7), (2, 8)]


def test_events_without_numbers_are_never_flagged(spark):
    df = labelled(readings(spark, [(1, "0:00", 1.0, 0.0), (1, "0:05", 1.0, 0.0)]), [None, None])
    assert m.timestamp_issue(df).count() == 2


NEW = ("timestamp", "time_end", "cooking_time", "seq_time", "energy", "energy_end", "end_added")


def test_small_gap_behind_an_event(spark):
    df = m.addtoevent_ending(m.cooking_event(readings(spark, TWO_SESSIONS)))
    rows = rows_of(df, *NEW)
    assert len(rows) == 6
    assert rows[3] == (
        at("0:12:24"), at("0:12:24"), 12.4, 12.4, 10.2, 10.2, 1,
    )
    assert rows[0][1:3] == (at("0:12:24"), 12.4)
    assert rows[4][1:3] == (None, None) and rows[4][5] is None
    kept = m.addtoevent_ending(
        m.cooking_event(readings(spark, TWO_SESSIONS), profile=DOCUMENTED), profile=DOCUMENTED
    )
    assert rows_of(kept, *NEW)[4][1:3] == (at("2:05"), 5.0)


@pytest.mark.parametrize("profile, sign", [(EFFECTIVE, -1), (DOCUMENTED, 1)], ids=["effective", "documented"])
def test_large_gap_behind_an_event(spark, profile, sign):
    df = labelled(readings(spark, [(1, "0:00", 1.0, 0.5), (1, "1:00", 1.2, 0.5)]), [1, None])
    row = rows_of(m.addtoevent_ending(df, profile=profile).filter("end_added = 1"), *NEW)
    end = at("0:05")
    assert row == [(end, end, 15.0, 15.0, 1.083333, round(1 + sign * 5 / 60, 6), 1)]


START = ("timestamp", "time_start", "cooking_time", "seq_time", "energy", "energy_start")


@pytest.mark.parametrize(
    "profile, gap, minutes, moved",
    [
        (EFFECTIVE, 0.03, 1.8, 6.8),
        (DOCUMENTED, 0.03, 1.8, 1.8),
        (EFFECTIVE, 0.20, 5.0, 0.0),
        (DOCUMENTED, 0.20, 5.0, 5.0),
    ],
)
def test_gap_before_an_event(spark, profile, gap, minutes, moved):
    df = labelled(readings(spark, [(1, "0:00", 1.0, 0.5), (1, "1:00", 1.0 + gap, 0.5)]), [None, 7])
    for scale in (m.Scale(), m.Scale(hot_meter_rows=1, strip_rows=101)):
        added = m.addtoevent_beginning(df, profile=profile, scale=scale).filter("start_added = 1")
        row = rows_of(added, *START)
        when = at("1:00") - timedelta(minutes=moved)
        low = round(1.0 + gap - min(gap, 5 / 60), 6)
        assert row == [(when, when, 10 + minutes, 10 - minutes, low, low)]

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest

import meterline as m
from meterline.params import DOCUMENTED, EFFECTIVE
from meterline.operators.timeline import Frame
from meterline.params import Params, Scale
from meterline.operators.sessions import session_frame
from tests.helpers import IDLE_TAIL, SPLIT, TWO_SESSIONS, at, readings, rows_of

SHOWN = ("cooking_start", "cooking_end", "cooking_event", "cooking_time", "seq_time")


def test_two_sessions(spark):
    got = rows_of(m.cooking_event(readings(spark, TWO_SESSIONS)), *SHOWN)
    assert got == [
        (True, False, 1, 10.0, 0.0),
        (False, False, 1, 10.0, 5.0),
        (False, True, 1, 10.0, 10.0),
        (True, False, 2, 5.0, 0.0),
        (False, False, 2, 5.0, 5.0),
    ]
    documented = m.cooking_event(readings(spark, TWO_SESSIONS), profile=DOCUMENTED)
    assert rows_of(documented, *SHOWN)[4] == (False, True, 2, 5.0, 5.0)


def test_idle_tail_is_cut_off(spark):
    got = rows_of(m.cooking_event(readings(spark, IDLE_TAIL)), *SHOWN[:3])
    assert got == [
        (True, False, 1),
        (False, True, 1),
        (True, True, None),
        (True, True, None),
        (False, False, None),
    ]
    # Described behaviour, but with equal counters still ending an event.
    profile = replace(DOCUMENTED, equal_energy_ends=True)
    got = rows_of(m.cooking_event(readings(spark, IDLE_TAIL), profile=profile), *SHOWN[:3])
    assert got[4] == (True, True, None)


def test_loads_carry_over_to_the_next_meter(spark):
    rows = [(1, "0:00", 1.0, 0.0), (1, "0:05", 1.1, 0.9), (2, "3:00", 5.0, 0.0), (2, "3:05", 5.0, 0.0)]
    df = readings(spark, rows)
    carried = rows_of(m.cooking_event(df), "timestamp_load")
    assert [v for (v,) in carried] == [at("0:00"), at("0:05"), at("0:05"), at("0:05")]
    own = rows_of(m.cooking_event(df, profile=DOCUMENTED), "timestamp_load")
    assert [v for (v,) in own] == [at("0:00"), at("0:05"), at("3:00"), at("3:00")]


def random_readings(spark, seed, meters=5, rows=120):
    rng, data = random.Random(seed), []
    for meter in range(meters):
        when, energy = at("0:00"), 10.0 * meter
        for _ in range(rows):
            when += timedelta(minutes=rng.choice([5, 5, 5, 5, 10, 40]))
            power = rng.choice([0.0, 0.0, 0.1, 0.5, 0.9])
            energy += rng.choice([0.0, power / 12, 0.06])
            e = None if rng.random() < 0.03 else round(energy, 4)
            data.append((meter, when, e, None if rng.random() < 0.03 else power))
    return readings(spark, data)


ALL = (
    "meter_number", "id", "load", "load_count", "timestamp_load", "cooking_start", "cooking_end",
    "cooking_event", "time_start", "energy_start", "time_end", "energy_end", "cooking_time", "seq_time",
)


@pytest.mark.parametrize("profile", [EFFECTIVE, DOCUMENTED], ids=["effective", "documented"])
def test_partitioning_and_splitting_do_not_matter(spark, profile):
    df = random_readings(spark, 1)
    whole = rows_of(m.cooking_event(df, profile=profile), *ALL)
    shuffled = df.repartition(5, "id")
    assert rows_of(m.cooking_event(shuffled, profile=profile), *ALL) == whole
    assert rows_of(m.cooking_event(df, profile=profile, scale=SPLIT), *ALL) == whole
    blocks = Scale(scan_rows=1)
    assert rows_of(m.cooking_event(df, profile=profile, scale=blocks), *ALL) == whole


def test_stacked_frame_agrees_with_carried_context(spark):
    df = random_readings(spark, 2)
    stacked = Frame.stacked(df, Scale(strip_rows=101))
    got = rows_of(session_frame(stacked, Params(), EFFECTIVE).union(), *ALL)
    assert got == rows_of(m.cooking_event(df), *ALL)


def test_numbers_have_no_gaps_and_meters_start_events(spark):
    df = m.cooking_event(random_readings(spark, 3))
    rows = rows_of(df, "meter_number", "cooking_start", "cooking_event")
    seen, number = None, 0
    for meter, start, event in rows:
        assert start or meter == seen
        number += start
        assert event in (None, number)
        seen = meter


def test_one_meter_alone_equals_its_part_of_the_whole(spark):
    df = random_readings(spark, 4)
    names = [c for c in ALL if c != "cooking_event"]
    whole = m.cooking_event(df, profile=DOCUMENTED).filter("meter_number = 3")
    alone = m.cooking_event(df.filter("meter_number = 3"), profile=DOCUMENTED)
    assert rows_of(whole, *names) == rows_of(alone, *names)


def test_session_time_zone_does_not_matter(spark):
    rows = [
        (1, datetime(2024, 3, 10, 1, 50), 1.0, 0.9),
        (1, datetime(2024, 3, 10, 2, 5), 1.1, 0.9),
        (1, datetime(2024, 3, 10, 3, 10), 1.2, 0.9),
        (1, datetime(2024, 3, 10, 3, 15), 1.3, 0.9),
    ]
    df = readings(spark, rows)
    columns = [c for c in ALL if not c.startswith("time")]
    expected = rows_of(m.cooking_event(df), *columns, "diff_prev_timestamp")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert rows_of(m.cooking_event(df), *columns, "diff_prev_timestamp") == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r[-1] for r in expected] == [None, 15 * 60e6, 65 * 60e6, 5 * 60e6]

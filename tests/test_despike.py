import random
from datetime import timedelta

import pytest

import meterline as m
from meterline.operators import despike
from meterline.operators.timeline import Frame
from meterline.params import DOCUMENTED, EFFECTIVE, Params
from tests.helpers import SPLIT, at, readings, rows_of


def despiked(spark, energies, profile=EFFECTIVE, meter=1, **kw):
    rows = [(meter, at("0:00") + timedelta(minutes=5 * i), e, 0.0) for i, e in enumerate(energies)]
    return [v for (v,) in rows_of(m.remove_spikes(readings(spark, rows), profile=profile, **kw), "energy")]


@pytest.mark.parametrize(
    "energies, expected",
    [
        ([1.0, 9.0, 9.5, 1.2, 1.3], [1.0, 1.2, 1.2, 1.2, 1.3]),
        ([2.5, 1.8, 1.0], [2.5, 1.8, 1.0]),
        ([3.0, None, 1.0], [3.0, None, 1.0]),
        ([9.0] * 101 + [1.0], [9.0] + [1.0] * 101),
    ],
)
def test_spikes_are_lowered_to_the_next_reading(spark, energies, expected):
    assert despiked(spark, energies) == expected


def test_fixpoint_repairs_long_spikes(spark):
    assert despiked(spark, [9.0] * 130 + [1.0], DOCUMENTED) == [1.0] * 131


def fold(energies, margin=1.0):
    values = list(energies)
    for i in range(len(values) - 2, -1, -1):
        if None not in (values[i], values[i + 1]) and values[i] > values[i + 1] + margin:
            values[i] = values[i + 1]
    return values


@pytest.mark.parametrize("block", [3, 200])
def test_fixpoint_of_any_length(spark, monkeypatch, block):
    """Long spikes, slopes within the margin, missing readings and resets; one plan for all lengths."""
    monkeypatch.setattr(despike, "BLOCK", block)
    rng = random.Random(block)
    meters = [
        [1.0] * 5 + [30.0] * 300 + [2.0] * 4,
        [1.0] * 5 + [30.0] * 3000 + [2.0] * 4,
        [round(900 - 0.9 * i, 3) for i in range(700)],
        [round(rng.random() * 30, 3) for _ in range(600)],
        [None if rng.random() < 0.02 else round(rng.choice([0, 0, 9]) + rng.random() * 3, 3) for _ in range(900)],
        [None, 5.0, None, None, 9.0, 1.0, None],
        [7.5],
    ]
    rows, expected = [], []
    for meter, energies in enumerate(meters):
        rows += [(meter, at("0:00") + timedelta(minutes=i), e, 0.0) for i, e in enumerate(energies)]
        expected += fold(energies)
    df = readings(spark, rows)
    for scale in (m.Scale(), SPLIT, m.Scale(hot_meter_rows=500, strip_rows=1000)):
        got = m.remove_spikes(df, profile=DOCUMENTED, scale=scale)
        assert [v for (v,) in rows_of(got, "energy")] == expected


def test_fixpoint_runs_no_job_and_one_exchange(spark, tmp_path):
    path = str(tmp_path / "r")
    readings(spark, [(1, "0:00", 1.0, 0.0)]).write.parquet(path)
    frame = Frame.split(spark.read.parquet(path), m.Scale())
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup()
    done = despike.despike_frame(frame, m.Params(), DOCUMENTED).union()
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == jobs
    text = done._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "SinglePartition" not in text


def test_meters_do_not_touch(spark):
    rows = [(1, "0:00", 40.0, 0.0), (1, "0:05", 50.0, 0.0), (2, "0:00", 1.0, 0.0)]
    assert rows_of(m.remove_spikes(readings(spark, rows)), "energy") == [(40.0,), (50.0,), (1.0,)]


def rounds_by_hand(energies, rounds, margin=1.0):
    values = list(energies)
    for _ in range(rounds):
        old = list(values)
        for i in range(len(old) - 1):
            if old[i] is not None and old[i + 1] is not None and old[i] > old[i + 1] + margin:
                values[i] = old[i + 1]
    return values


@pytest.mark.parametrize("rounds", [3, 100])
def test_one_pass_equals_repeated_rounds(spark, rounds):
    rng = random.Random(rounds)
    rows, expected = [], []
    for meter in range(4):
        energies = [
            None if rng.random() < 0.05 else round(rng.choice([0, 0, 0, 6]) + rng.random() * 2.5, 3)
            for _ in range(250)
        ]
        start = at("0:00")
        rows += [(meter, start + timedelta(minutes=i), e, 0.0) for i, e in enumerate(energies)]
        expected += rounds_by_hand(energies, rounds)
    df, params = readings(spark, rows), Params(spike_rounds=rounds)
    assert [v for (v,) in rows_of(m.remove_spikes(df, params), "energy")] == expected
    split = m.remove_spikes(df, params, scale=SPLIT)
    assert [v for (v,) in rows_of(split, "energy")] == expected

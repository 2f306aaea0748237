"""A chain gives what the plain functions give, with less shuffling and fewer jobs."""

import pytest

import meterline as m
from meterline.params import Scale
from tests.helpers import TWO_SESSIONS, readings
from tests.test_plans_and_scans import plan

ROWS = [(meter, clock, energy, power) for meter in (1, 2) for _, clock, energy, power in TWO_SESSIONS]


def stored(spark, tmp_path):
    path = str(tmp_path / "readings")
    readings(spark, ROWS + [(None, "1:00", 3.0, 0.5)]).write.parquet(path)
    return spark.read.parquet(path)


def in_steps(df, profile, scale):
    df = m.cooking_event(m.remove_spikes(df, profile=profile, scale=scale), profile=profile, scale=scale)
    df = m.timestamp_issue(df, profile=profile, scale=scale)
    df = m.addtoevent_ending(df, profile=profile, scale=scale)
    return m.addtoevent_beginning(df, profile=profile, scale=scale)


def chained(df, profile, scale):
    steps = m.chain(df, profile=profile, scale=scale).remove_spikes().cooking_event().timestamp_issue()
    return steps.addtoevent_ending().addtoevent_beginning()


def rows(df):
    return sorted(repr(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize(
    "profile, scale",
    [(m.EFFECTIVE, Scale()), (m.DOCUMENTED, Scale()), (m.EFFECTIVE, Scale(hot_meter_rows=3, strip_rows=101))],
    ids=["effective", "documented", "split"],
)
def test_chain_equals_its_steps(spark, tmp_path, profile, scale):
    df = stored(spark, tmp_path)
    steps, chain = in_steps(df, profile, scale), chained(df, profile, scale)
    assert rows(chain.readings()) == rows(steps)
    assert rows(chain.only_events()) == rows(m.only_events(steps, profile=profile, scale=scale))


def test_chain_shuffles_by_meter_once(spark, tmp_path):
    by_meter = "Exchange hashpartitioning(meter_number"
    df = stored(spark, tmp_path)
    text = plan(chained(df, m.DOCUMENTED, Scale()).readings())
    assert text.count(by_meter) == 1


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        work().collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_chain_runs_fewer_jobs(spark, tmp_path):
    df = stored(spark, tmp_path)
    steps = jobs(spark, "steps", lambda: m.only_events(m.cooking_event(in_steps(df, m.EFFECTIVE, Scale()))))
    chain = jobs(spark, "chain", lambda: chained(df, m.EFFECTIVE, Scale()).cooking_event().only_events())
    assert chain <= 0.6 * steps  # 44 and 83 when this was written


def test_steps_on_events_need_events(spark):
    with pytest.raises(ValueError, match="cooking_event"):
        m.chain(readings(spark, ROWS)).timestamp_issue()

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import meterline as m
from meterline.operators.zone import shift_zone
from meterline.params import DOCUMENTED, EFFECTIVE
from meterline.sources.files import read_csv, read_parquet, write_csv
from tests.helpers import TWO_SESSIONS, readings, rows_of


def test_event_table(spark):
    extra = [(230.0, 0.0), (None, 4.0), (231.0, 4.0)]
    rows = [(*r, *e) for r, e in zip(TWO_SESSIONS[:3], extra)]
    events = m.only_events(m.cooking_event(readings(spark, rows)))
    got = events.toPandas().round(6).to_dict("records")[0]
    timestamp = got.pop("timestamp")
    assert timestamp.to_pydatetime() == datetime(2024, 1, 1)
    assert got == {
        "meter_number": 1, "cooking_event": 1, "energy": 10.16, "energy_gen": 0.16, "power": 0.6,
        "cooking_time": 10.0, "current": 2.666667, "no_recordings": 2, "id": 2.0,
        "power_mean": 0.96, "cooking_cost": 16.0, "event_count": 1,
    }
    documented = m.only_events(m.cooking_event(readings(spark, rows)), profile=DOCUMENTED)
    assert documented.first()["no_recordings"] == 3


STAMPS = ["2020-03-08 23:59:59", "2020-03-09 00:00:00", "2020-11-14 23:59:59", "2020-11-15 00:00:00", None]


@pytest.mark.parametrize("profile, kept", [(EFFECTIVE, [1, 2, 4]), (DOCUMENTED, [1, 2])])
def test_period(spark, profile, kept):
    df = spark.createDataFrame(list(enumerate(STAMPS)), "id long, timestamp string")
    assert sorted(r.id for r in m.period(df, profile=profile).collect()) == kept


@pytest.mark.parametrize(
    "zone, profile, hours",
    [("UTC+00:00", EFFECTIVE, 0), ("UTC+00:00", DOCUMENTED, 3), ("UTC00:00", EFFECTIVE, 3), ("UTC00:00", DOCUMENTED, 0)],
)
def test_zone(spark, zone, profile, hours):
    df = readings(spark, TWO_SESSIONS)
    df = df.withColumn("timezone", F.when(F.col("id") == 3, zone).otherwise("UTC+02:00"))
    got = rows_of(shift_zone(df, profile), "timestamp", "timezone")
    assert got[0][0].hour == hours
    assert {z for _, z in got} == ({"UTC+03:00"} if hours else {zone, "UTC+02:00"})


def test_files(spark, tmp_path):
    df = readings(spark, [(1, "0:00", 1.25, 0.0, None, None), (2, "0:05:01.5", None, 0.9, 230.0, 4.0)])
    write_csv(df, str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out"))
    assert back.schema == df.schema
    assert rows_of(back, *df.columns) == rows_of(df, *df.columns)
    (tmp_path / "raw.csv").write_text("meter_number,energy,power,note\n1,NaN,NA,x\n2,,0.5,y\n")
    raw = read_csv(spark, str(tmp_path / "raw.csv"))
    assert [tuple(r) for r in raw.orderBy("meter_number").collect()] == [
        (1, None, None, "x"), (2, None, 0.5, "y"),
    ]
    df.write.parquet(str(tmp_path / "pq"))
    assert read_parquet(spark, str(tmp_path / "pq")).count() == 2

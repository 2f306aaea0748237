import random

from pyspark.sql import functions as F

import meterline as m
from meterline.operators import sessions, timeline
from meterline.operators.despike import despike_frame
from meterline.operators.scan import exclusive_scan
from meterline.operators.sessions import session_frame
from meterline.operators.slices import of_meter
from meterline.operators.timeline import Frame, with_positions
from meterline.params import DOCUMENTED, Params, Scale
from tests.helpers import TWO_SESSIONS, readings


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path):
    path = str(tmp_path / "readings")
    readings(spark, TWO_SESSIONS * 3).write.parquet(path)
    return spark.read.parquet(path)


def test_spikes_rules_and_bounds_share_one_exchange(spark, tmp_path):
    frame = despike_frame(Frame.split(stored(spark, tmp_path), Scale()), Params(), m.EFFECTIVE)
    frame = session_frame(frame, Params(), DOCUMENTED, numbered=False)
    text = plan(frame.union())
    assert text.count("Exchange") == 1 and "hashpartitioning(meter_number" in text
    assert "SinglePartition" not in text and "Python" not in text


def test_strips_of_a_stacked_frame_scan_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(timeline, "STRIP_BITS", 2)
    df = spark.range(1000).select((F.col("id") % 7).alias("meter_number"), F.col("id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("timestamp"), (F.col("id") % 3).alias("n"))
    frame = Frame.stacked(df, Scale(strip_rows=10))
    part = frame.parts[0]
    value = F.when(F.col("n") == 0, F.col("id"))
    done = part.layout.running(part.df, lasts={"latest": value}, sums={"total": F.col("n")})
    text = plan(done)
    # One task sees the totals of superblocks (2 ** 24 strips each) alone; strips are scanned by block.
    assert text.count("SinglePartition") == 1 and "windowspecdefinition(_block#" in text and "windowspecdefinition(_superblock#" in text
    total, latest = 0, None
    for row in done.orderBy(timeline.POS).collect():
        total, latest = total + row["n"], row["id"] if row["n"] == 0 else latest
        assert (row["total"], row["latest"]) == (total, latest)


def test_meter_filter_reaches_the_scan(spark, tmp_path):
    text = plan(of_meter(m.remove_spikes(stored(spark, tmp_path)), 1))
    assert "EqualTo(meter_number,1)" in text


def test_event_table_reads_only_its_columns(spark, tmp_path):
    df = stored(spark, tmp_path).withColumn("cooking_event", F.col("id"))
    from meterline.operators.summary import event_energy

    text = plan(event_energy(df.withColumn("cooking_time", F.lit(1.0))))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "timezone" not in scan.split("ReadSchema")[1]
    assert "partial_max" in text


def test_positions_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("key"))
    got = with_positions(df, ["key"], "place").collect()
    assert all(r["key"] == r["place"] for r in got) and len(got) == 1000


def test_blocks_of_meters_scan_like_one_window(spark):
    rng = random.Random(5)
    ids = sorted({rng.choice([rng.randrange(50), rng.randrange(2**62), -rng.randrange(2**50)]) for _ in range(300)})
    rows = [(i, rng.randrange(9), rng.choice([None, float(i % 97)])) for i in ids]
    df = spark.createDataFrame(rows, "meter_number long, n long, v double")
    results = [
        sorted(tuple(r) for r in exclusive_scan(df, ["n"], ["v"], len(rows), limit).collect())
        for limit in (1000, 0)
    ]
    total, last, expected = 0, None, []
    for meter, n, v in rows:
        expected.append((meter, total, last))
        total, last = total + n, last if v is None else v
    key = lambda r: r[0]
    assert [sorted(r, key=key) for r in results] == [expected, expected]


def test_a_task_holds_so_many_rows_at_most(spark, tmp_path):
    path, scale = str(tmp_path / "many"), Scale(task_rows=400)
    spark.range(20_000).select(
        (F.col("id") % 2000).alias("meter_number"), "id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("timestamp"),
        F.lit("UTC+03:00").alias("timezone"), (F.col("id") / 1000).alias("energy"), F.lit(0.0).alias("power"),
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = Frame.split(rows, scale).union().groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 40 and max(r["count"] for r in sizes) <= 800
    # Meters that are longer than a strip, but too many to be listed as heavy, stay ordinary.
    frame = Frame.split(rows, Scale(hot_meter_rows=5, strip_rows=128, max_hot_meters=1000))
    assert len(frame.parts) == 1 and frame.hot is None


def stored_columns(monkeypatch, module) -> list[list[str]]:
    """Columns of every table that the module stores from now on."""
    found, pin = [], module.pin
    monkeypatch.setattr(module, "pin", lambda df: found.append(df.columns) or pin(df))
    return found


def test_rows_are_stored_before_meters_are_summarised(spark, tmp_path, monkeypatch):
    found = stored_columns(monkeypatch, sessions)
    frame = sessions.flag_frame(Frame.split(stored(spark, tmp_path), Scale()), Params(), m.EFFECTIVE)
    assert "load" in found[0] and "load_ts" in found[1] and len(found) == 2
    # The salt is for readings without a meter number alone.
    assert timeline.LONE not in frame.parts[0].df.columns


def test_running_values_of_strips_are_stored_with_the_rows(spark, tmp_path, monkeypatch):
    frame = Frame.stacked(stored(spark, tmp_path), Scale(strip_rows=101))
    found = stored_columns(monkeypatch, timeline)
    session_frame(frame, Params(), DOCUMENTED, keep=True)
    # Twice the rows and one row per strip; the bounds of events store nothing again.
    assert "load_count" in found[0] and sessions.RAW_EVENT in found[2] and len(found) == 4

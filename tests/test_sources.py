"""Folders with several headers, files in order, and periods that read the days they need."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meterline.operators.slices import period
from meterline.operators.zone import shift_zone
from meterline.params import DOCUMENTED, EFFECTIVE
from meterline.sources.daily import read_period, write_by_day
from meterline.sources.files import normalise
from meterline.sources.folders import read_csv_folder
from meterline.sources.ordered import out_of_order, read_manifest, read_ordered, write_ordered

READING = "meter_number long, id long, timestamp timestamp_ntz, energy double, timezone string"


def readings(spark, n=400):
    start = datetime(2024, 3, 1)
    rows = [
        (i % 7 if i % 50 else None, i, start + timedelta(minutes=37 * ((i * 61) % n)) if i % 41 else None, i / 8, "UTC+03:00")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, READING).repartition(5)


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    files = {
        "a.csv": "meter_number,id,timestamp,energy\n1,10,2024-01-01 00:00:00,1.5\n1,11,2024-01-01 00:05:00,\n",
        "b c+d.csv": "energy,timestamp,id,meter_number,note\n2.5,2024-01-01 00:00:00.25,20,2,\"x, y\"\n",
        "again.csv": "\ufeffmeter_number,id,timestamp,energy\n1,12,2024-01-01 00:10:00,3\n",
        "header only.csv": "id,energy\n",
        "empty.csv": "",
        "bad.csv": "id,meter_number,energy\n30,3,4\n31,3\n32,3,five\n33,3,6,7\n34,,8\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = read_csv_folder(spark, str(tmp_path))
    rows = {r["id"]: r for r in got.rows.collect()}
    assert sorted(rows) == [10, 11, 12, 20, 30, 34]
    assert rows[20]["meter_number"] == 2 and rows[20]["energy"] == 2.5 and rows[20]["note"] == "x, y"
    assert rows[20]["timestamp"] == datetime(2024, 1, 1, 0, 0, 0, 250000)
    assert rows[11]["energy"] is None and rows[30]["timestamp"] is None and rows[34]["meter_number"] is None
    assert sorted(r["line"] for r in got.bad.collect()) == ["31,3", "32,3,five", "33,3,6,7"]
    counted = got.bad_by_file().collect()
    assert [(r["file"].rsplit("/", 1)[1], r["lines"]) for r in counted] == [("bad.csv", 3)]
    assert got.rows.count() == got.rows.select("id").count() == got.rows.select("energy").count() == 6
    assert got.bad.count() == 3


def test_headers_that_cannot_be_told_apart_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,energy,id\n1,2,3\n")
    with pytest.raises(ValueError, match="twice"):
        read_csv_folder(spark, str(tmp_path))


def test_a_folder_without_lines_has_no_readings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    got = read_csv_folder(spark, str(tmp_path))
    assert got.rows.count() == got.bad.count() == 0 and "energy" in got.rows.columns


def plain(path):
    """Ids in the order in which the files are read one after the other."""
    ids = []
    for file in sorted(Path(path).glob("part-*.csv")):
        lines = file.read_text().splitlines()
        at = lines[0].split(",").index("id") if lines else 0
        ids += [int(line.split(",")[at]) for line in lines[1:]]
    return ids


def test_ordered_files_follow_each_other(spark, tmp_path):
    df, path = readings(spark), str(tmp_path / "out")
    want = [
        r["id"]
        for r in sorted(
            df.collect(), key=lambda r: (r["meter_number"] is not None, r["meter_number"] or 0, r["id"])
        )
    ]
    manifest = write_ordered(df, path, ["meter_number", "id"])
    assert plain(path) == want
    files = manifest.orderBy("part", "chunk").collect()
    assert sum(f["rows"] for f in files) == len(want)
    assert all(a["start"] + a["rows"] == b["start"] and a["last"] < b["first"] for a, b in zip(files, files[1:]) if a["last"]["meter_number"] is not None)
    assert out_of_order(read_manifest(spark, path)).count() == 0
    placed = {r["place"]: r["id"] for r in read_ordered(spark, path).collect()}
    assert [placed[n] for n in range(len(want))] == want


def test_places_hold_where_files_are_read_in_pieces(spark, tmp_path):
    path = str(tmp_path / "out")
    write_ordered(readings(spark, 3000), path, ["id"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        assert all(r["place"] == r["id"] for r in read_ordered(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_out_of_order_are_found(spark, tmp_path):
    path = str(tmp_path / "out")
    manifest = write_ordered(readings(spark), path, ["id"])
    turned = manifest.withColumn("part", -manifest["part"])
    assert manifest.count() < 2 or out_of_order(turned).count() > 0


@pytest.mark.parametrize("profile", [EFFECTIVE, DOCUMENTED])
@pytest.mark.parametrize("zone", ["UTC+03:00", "UTC+00:00", "UTC00:00"])
def test_a_period_reads_its_days(spark, tmp_path, profile, zone):
    df, path = readings(spark).na.replace({"UTC+03:00": zone}, subset=["timezone"]), str(tmp_path / "days")
    write_by_day(df, path)
    got = read_period(spark, path, "2024-03-03", "2024-03-05", profile)
    want = period(shift_zone(normalise(df), profile), "2024-03-03", "2024-03-05", profile)
    assert sorted(map(repr, got.select(*df.columns).collect())) == sorted(map(repr, want.select(*df.columns).collect()))
    assert got.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "PartitionFilters: [" in plan and "recorded_day" in plan
    read = {f.split("recorded_day=")[1].split("/")[0] for f in spark.read.parquet(path).inputFiles()}
    assert len(read) > 8


def test_only_days_of_the_period_are_opened(spark, tmp_path):
    path = str(tmp_path / "days")
    write_by_day(readings(spark), path)
    got = read_period(spark, path, "2024-03-03", "2024-03-05", DOCUMENTED)
    days = {r[0] for r in got.select(F.regexp_extract("_metadata.file_path", "recorded_day=([^/]*)", 1)).collect()}
    assert days <= {"2024-03-02", "2024-03-03", "2024-03-04", "2024-03-05"} and days

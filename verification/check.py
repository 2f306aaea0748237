"""Compare queries with their SQL: ``python -m verification.check [sf_dir] [name ...]``."""

from __future__ import annotations

import numbers
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from meterline.session import configure
from verification.queries import QUERIES


def local_session() -> SparkSession:
    spark = (
        configure(SparkSession.builder)
        .master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _text(value) -> str:
    if value is None or value is pd.NA or value is pd.NaT or value == "NaT" or value != value:
        return ""
    if isinstance(value, numbers.Number) and not isinstance(value, (bool, np.bool_)):
        return repr(float(value))
    return str(value)


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if "datetime" in str(df[c].dtype):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        df[c] = df[c].astype(object).map(_text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str:
    fn, sql = QUERIES[name]
    start = time.time()
    got = canonical(fn(spark, sf_dir).toPandas())
    took = time.time() - start
    want = canonical(con.execute(sql).df())
    if list(got.columns) != list(want.columns):
        return f"COLUMNS {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}"
    bad = {c: int((got[c] != want[c]).sum()) for c in got.columns if (got[c] != want[c]).any()}
    return f"{'DIFF ' + str(bad) if bad else 'ok'} rows={len(got)} {took:.1f}s"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    return con


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name in sys.argv[2:] or QUERIES:
        try:
            outcome = compare(spark, con, sf_dir, name)
        except Exception as error:
            outcome = f"ERROR {str(error)[:1500]}"
        failed += " ok " not in f" {outcome} "
        print(f"{name}: {outcome}", flush=True)
    print(f"{failed} of {len(sys.argv[2:] or QUERIES)} differ")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())

"""Cutting lineage on storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

_pinned: dict[str, list[str]] = {}  # folders by application


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the session names; fall back to a temporary one in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get(SETTING, None) or context.getConf().get(SETTING)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="meterline-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Materialise once, so that several branches read the same rows instead of recomputing them.

    A compressed table in the shared folder survives the loss of executors, and its readers scan
    only the columns they need. The files stay until ``release`` or until the checkpoint folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _pinned.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove all tables pinned so far by this application; returns how many.

    DataFrames that were built with them can no longer be read, so consume or write results first.
    """
    context = spark.sparkContext
    paths = _pinned.pop(context.applicationId, [])
    for name in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)

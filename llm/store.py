"""Tables that outlive an executor, and settings for the jobs that write them."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.operators.pinning import ensure_checkpoint_dir

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends: its result is a table by then.

    Batches that go to Python hold 4 MB inside, since executor and worker keep some of them at a time.
    """
    wanted = {FREE_SHUFFLES: "true", BATCH_BYTES: str(4 << 20)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()[:1]}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A side of a join that has been counted is broadcast up to so many rows of a few numbers (about 32 MB).
BROADCAST_ROWS = 1_000_000


#: The same for rows that hold arrays, by the number of their elements (up to 40 bytes each).
BROADCAST_ELEMENTS = 1_000_000


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join with a written table of narrow rows: broadcast while its counted rows are few, else shuffled."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)

"""Files in row order, with a manifest of what each one holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.schema import READINGS
from meterline.sources.files import read_csv, write_csv

MANIFEST = "_manifest"  # readers skip folders whose names start so
PLACE = "place"
# How numbered files are called.
FILE_NUMBERS = r"part-(\d+)-.*-c(\d+)[^/]*$"


def _number(group: int) -> Column:
    return F.regexp_extract("_file", FILE_NUMBERS, group).cast("long")


def _with_source(df: DataFrame) -> DataFrame:
    """Rows with their file, block and a number that rises within the block."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).withColumn("_id", F.monotonically_increasing_id())


def write_ordered(df: DataFrame, path: str, order: list[str]) -> DataFrame:
    """CSV files that follow each other in ``order`` (nulls first), and their manifest, which is returned.

    Ranges of the order are dealt to tasks and sorted there, so nothing is gathered; rows that are
    equal in all columns of the order share a file, so end it with a unique one. The manifest has a row a file:
    number, file, rows, first and last key, and how many rows come before. It is read from the files.
    """
    write_csv(df.repartitionByRange(*order).sortWithinPartitions(*order), path)
    spark = df.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    rows = _with_source(read_csv(spark, path, schema))
    key = F.struct(*order)
    files = rows.groupBy("_file").agg(
        F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last")
    )
    before = Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    manifest = files.select(_number(1).alias("part"), _number(2).alias("chunk"), F.col("_file").alias("file"), "rows", "first", "last")
    manifest = manifest.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    manifest.write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{MANIFEST}")


def out_of_order(manifest: DataFrame) -> DataFrame:
    """Files that begin before the one in front of them ends; none if the files are in order."""
    window = Window.orderBy("part", "chunk")
    return manifest.withColumn("before", F.lag("last").over(window)).filter(F.col("first") < F.col("before"))


def read_ordered(spark: SparkSession, path: str, schema: T.StructType = READINGS) -> DataFrame:
    """The rows of ordered files with ``place``, their position from 0 in the order of the files.

    A block's position is the number of rows in the blocks before it: one small row a block is
    summed, rows themselves are numbered where they are read.
    """
    rows = _with_source(read_csv(spark, path, schema))
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    before = Window.orderBy(_number(1), _number(2), "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    placed = rows.join(blocks, ["_file", "_block"])
    return placed.withColumn(PLACE, F.col("_start") + F.col("_id") - F.col("_first")).drop(
        "_file", "_block", "_id", "_rows", "_first", "_start"
    )

"""CSV folders whose files differ in their headers."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.schema import READINGS
from meterline.sources.files import CSV_TIMESTAMP, normalise

LINE = "_line"
FILE = "_file"
MAX_HEADERS = 1000


@dataclass(frozen=True)
class CsvFolder:
    """What a folder holds: readings of all files, and lines put aside as (file, line)."""

    rows: DataFrame
    bad: DataFrame

    def bad_by_file(self) -> DataFrame:
        """(file, lines): how many lines of each file were put aside; files without any are left out."""
        return self.bad.groupBy("file").agg(F.count("*").alias("lines"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header) of every file with a line in it: its first line that is not blank."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    # Rows of one file's first block are read in order by one task.
    first = lines.filter((F.col("block") == 0) & (F.trim("value") != ""))
    first = first.withColumn("at", F.monotonically_increasing_id())
    return first.groupBy("file").agg(F.min_by("value", "at").alias("header"))


def _columns(header: str) -> list[str]:
    names = next(csv.reader([header.lstrip("\ufeff")]))
    if len(set(names)) < len(names):
        raise ValueError(f"a header names a column twice: {names}")
    return names


def _group(spark: SparkSession, files: list[str], names: list[str], schema: T.StructType) -> DataFrame:
    known = {field.name: field for field in schema.fields}
    declared = [known.get(name, T.StructField(name, T.StringType())) for name in names]
    scan = (
        spark.read.option("header", True)
        .option("timestampNTZFormat", CSV_TIMESTAMP)
        .option("columnNameOfCorruptRecord", LINE)
        .csv(files, schema=T.StructType([*declared, T.StructField(LINE, T.StringType())]))
    )
    # The reader judges a line by the fields that a query needs; all of them beside it make that the same for every query.
    fields = [F.col(f"`{name}`").cast("string") for name in names]
    return scan.withColumns({LINE: F.element_at(F.array(F.col(LINE), *fields), 1), FILE: F.col("_metadata.file_path")})


def read_csv_folder(spark: SparkSession, path: str, schema: T.StructType = READINGS) -> CsvFolder:
    """Readings of a folder of CSV files, each matched by the column names of its own header.

    Files are grouped by header, and each group is one scan with declared types; columns that a file
    lacks are null. Lines with another number of fields than their header, or with a value that is
    not of its column's type, are put aside. Headers differ by name or order of columns; more than
    ``MAX_HEADERS`` different ones are refused, as each is a scan of its own.
    """
    # Paths in the metadata are encoded as URIs; a plus sign stands for itself there.
    decoded = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    groups = headers(spark, path).groupBy("header").agg(F.sort_array(F.collect_list(decoded)).alias("files"))
    found = groups.orderBy("header").limit(MAX_HEADERS + 1).collect()
    if len(found) > MAX_HEADERS:
        raise ValueError(f"{path} has more than {MAX_HEADERS} different headers")
    if not found:
        empty = spark.createDataFrame([], schema)
        return CsvFolder(empty, spark.createDataFrame([], "file string, line string"))
    scans = [_group(spark, group["files"], _columns(group["header"]), schema) for group in found]
    whole = scans[0]
    for scan in scans[1:]:
        whole = whole.unionByName(scan, allowMissingColumns=True)
    names = [name for name in whole.columns if name not in (LINE, FILE)]
    order = [f for f in schema.fieldNames() if f in names]
    order += [name for name in names if name not in order]
    rows = whole.filter(F.col(LINE).isNull()).select(*order)
    bad = whole.filter(F.col(LINE).isNotNull()).select(F.col(FILE).alias("file"), F.col(LINE).alias("line"))
    return CsvFolder(normalise(rows), bad)

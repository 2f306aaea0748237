"""CSV and parquet readings in, CSV out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.functions.exprs import no_nan
from meterline.schema import READINGS

# The text format of timestamps in exchanged files.
CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def normalise(df: DataFrame) -> DataFrame:
    """Declared types, and null for every missing number."""
    columns = []
    for name in df.columns:
        if name in READINGS.fieldNames():
            declared = READINGS[name].dataType
            value = F.col(name).cast(declared)
            columns.append((no_nan(value) if declared == T.DoubleType() else value).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = READINGS) -> DataFrame:
    """Comma-separated readings with a header, matched by column name.

    The schema is declared, so nothing is scanned to infer it; columns the file lacks are left
    out. Unparsable numbers become null. All files of a folder must have the columns of the first in
    the same order; reading fails on one that has not.
    """
    present = spark.read.option("header", True).csv(path).columns  # reads the header only
    known = {field.name: field for field in schema.fields}
    declared = T.StructType(
        [known.get(name, T.StructField(name, T.StringType())) for name in present]
    )
    return normalise(
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("timestampNTZFormat", CSV_TIMESTAMP)
        .csv(path, schema=declared)
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    """Header, comma, no row numbers; one file per partition, in partition order."""
    (
        df.write.option("header", True)
        .option("timestampNTZFormat", CSV_TIMESTAMP)
        .mode("overwrite")
        .csv(path)
    )

"""Column names and the declared schema of raw readings."""

from __future__ import annotations

from pyspark.sql import types as T

METER = "meter_number"
TS = "timestamp"
EVENT = "cooking_event"

READINGS = T.StructType(
    [
        T.StructField("meter_number", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("timezone", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("energy", T.DoubleType()),
        T.StructField("voltage", T.DoubleType()),
        T.StructField("current", T.DoubleType()),
        T.StructField("power", T.DoubleType()),
        T.StructField("power_factor", T.DoubleType()),
        T.StructField("frequency", T.DoubleType()),
        T.StructField("fetch_index", T.LongType()),
        T.StructField("region", T.StringType()),
    ]
)

# Optional columns that the readings may lack.
OPTIONAL = ("power_factor", "frequency", "fetch_index", "region")


def require(df, *columns: str) -> None:
    """Fail early, with the missing names, instead of deep inside a plan."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"readings lack columns {missing}; present: {df.columns}")

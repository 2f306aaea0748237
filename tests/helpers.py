"""Small hand-made readings."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import types as T

from meterline.schema import READINGS
from meterline.params import Scale

DAY = datetime(2024, 1, 1)
COLUMNS = ["meter_number", "id", "timezone", "timestamp", "energy", "voltage", "current", "power"]
SCHEMA = T.StructType([READINGS[c] for c in COLUMNS])
SPLIT = Scale(hot_meter_rows=3, strip_rows=101)


def at(clock: str) -> datetime:
    parts = [float(p) for p in clock.split(":")] + [0.0]
    return DAY + timedelta(hours=parts[0], minutes=parts[1], seconds=parts[2])


def readings(spark, rows, zone="UTC+03:00"):
    """Rows of (meter, clock or datetime, energy, power[, voltage, current])."""
    full = []
    for i, row in enumerate(rows):
        meter, when, energy, power, *rest = row
        voltage, current = rest if rest else (230.0, 1.0)
        when = at(when) if isinstance(when, str) else when
        full.append((meter, i + 1, zone, when, energy, voltage, current, power))
    return spark.createDataFrame(full, SCHEMA)


def rows_of(df, *columns):
    order = [c for c in ("meter_number", "timestamp", "start_added", "start_source", "end_added",
                         "end_source", "id") if c in df.columns]
    frame = df.orderBy(*order).select(*columns).toPandas()
    return [tuple(plain(v) for v in row) for row in frame.itertuples(index=False)]


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.round("ms").to_pydatetime()  # added rows fall on truncated microseconds
    if isinstance(value, float):
        return round(value, 6)
    return value.item() if hasattr(value, "item") else value


TWO_SESSIONS = [
    (1, "0:00", 10.00, 0.0),
    (1, "0:05", 10.08, 0.9),
    (1, "0:10", 10.16, 0.9),
    (1, "2:00", 10.20, 0.8),
    (1, "2:05", 10.27, 0.8),
]
IDLE_TAIL = [
    (1, "0:00", 5.00, 0.0),
    (1, "0:05", 5.10, 0.9),
    (1, "0:10", 5.10, 0.0),
    (1, "0:15", 5.10, 0.0),
    (1, "0:20", 5.10, 0.0),
]

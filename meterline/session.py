"""Session settings the pipelines run well with."""

from __future__ import annotations

# A two-pass run generates several hundred classes; the default cache of 100 would compile them
# again in every job. Windows cost far more per byte than scans, so small shuffles still deserve many tasks. Column
# call sites are useful while debugging only; recording them doubles plan building time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder):
    """Apply the settings to a ``SparkSession.builder``; later ``config`` calls win."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder

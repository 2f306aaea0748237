"""Telling rows apart that share an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.store import drop, sized_join, written


def numbered(docs: DataFrame, id_column: str, text_column: str, weight: Column, name: str) -> tuple[DataFrame, bool]:
    """Adds what the rows of the same id before this one weigh together, in order of text; and whether any id is shared.

    Rows with an id of their own, or a null one, get 0. Rows equal in id and text stand for each other, so it does not matter
    which of them comes first. Only rows of shared ids are shuffled.
    """
    long_id = F.col(f"`{id_column}`").cast("long")
    ids = docs.select(long_id.alias("_shared_id")).where("_shared_id IS NOT NULL")
    shared = written(ids.groupBy("_shared_id").count().where("count > 1").select("_shared_id"), "shared")
    if shared.isEmpty():
        drop(docs.sparkSession, shared)
        return docs.withColumn(name, F.lit(0).cast("long")), False
    keyed = docs.withColumn("_shared_id", long_id)
    alone = sized_join(keyed, shared, ["_shared_id"], "left_anti").withColumn(name, F.lit(0).cast("long"))
    before = Window.partitionBy("_shared_id").orderBy(text_column).rowsBetween(Window.unboundedPreceding, -1)
    weighed = F.coalesce(F.sum(weight.cast("long")).over(before), F.lit(0).cast("long"))
    some = sized_join(keyed, shared, ["_shared_id"], "left_semi").withColumn(name, weighed)
    columns = [*docs.columns, name]
    return alone.select(*columns).unionByName(some.select(*columns)), True

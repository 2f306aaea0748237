"""The result depends on the readings alone, not on how they are partitioned, whatever their ids."""

import random

import pytest
from pyspark.sql import functions as F

import meterline as m
from meterline.params import Scale
from tests.helpers import readings


def scattered(spark):
    """Three meters; recordings in groups of up to four at one time, ids missing or shared, some rows sent twice."""
    rng = random.Random(11)
    rows, energy = [], 10.0
    for meter in (1, 2, 3):
        for minute in range(0, 400, 5):
            for _ in range(rng.choice([1, 1, 2, 4])):
                energy += rng.choice([0.0, 0.0, 0.06, 0.09])
                spike = rng.choice([0.0] * 15 + [5.0])
                rows.append((meter, f"{minute // 60}:{minute % 60:02d}", energy + spike, rng.choice([0.0, 0.9])))
                if rng.random() < 0.1:
                    rows.append(rows[-1])
    return readings(spark, rows)


@pytest.mark.parametrize("profile", [m.EFFECTIVE, m.DOCUMENTED], ids=["effective", "documented"])
@pytest.mark.parametrize("scale", [Scale(), Scale(hot_meter_rows=5, strip_rows=101)], ids=["whole", "split"])
def test_partitioning_does_not_show(spark, profile, scale):
    df = scattered(spark).select("*", F.explode(F.array(F.lit(None), F.lit(4))).alias("shared")).drop("id")
    for shared in (F.col("shared").isNull(), F.col("shared") == 4):
        given = df.filter(shared).withColumnRenamed("shared", "id").withColumn("id", F.col("id").cast("bigint"))
        found = set()
        for order in (given.repartition(2), given.repartition(5).orderBy(F.desc("energy")), given.coalesce(1).orderBy("power", "energy")):
            out = m.cooking_event(m.remove_spikes(order, profile=profile, scale=scale), profile=profile, scale=scale)
            found.add(tuple(sorted(map(repr, out.collect()))))
        assert len(found) == 1

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from llm.store import drop, written


def _starred(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each directed pair with the smallest id among u and the neighbours that u has here."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is tied to the smallest neighbour of u."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _starred(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _starred(down)
    return starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        starred.select("u", F.col("m").alias("v"))
    )


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id that occurs in a link; the component is its smallest id.

    Nulls and links from an id to itself tie nothing. Each round is written to the shared folder, so
    a lost executor costs no more than that round; rounds end when the links stay the same, which is
    after O(log^2 n) of them. All state is in tables; minima are pre-aggregated before the shuffle.
    """
    spark = links.sparkSession
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    before, last = None, None
    for _ in range(max_rounds):
        seen = Observation()
        after = _small_star(_large_star(edges)).where("u <> v").distinct()
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        edges = written(after.observe(seen, F.count("*").alias("n"), mark.alias("mark")), "links")
        if last is not None:
            drop(spark, last)
        last = edges
        if seen.get == before:
            break
        before = seen.get
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )

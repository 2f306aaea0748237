"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.store import partitions, written

#: At most about so many keys count as hot; their list is broadcast.
HOT_KEYS = 1 << 16


def hot_keys(counts: DataFrame, on: list[str], count: str, least: int = 1024) -> DataFrame:
    """The keys (a written table) that occur more than ``least`` times, at most about ``HOT_KEYS`` of them.

    ``counts`` has one row per key. Only total / limit keys can occur more than limit times, which bounds the result.
    """
    total = counts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    return written(counts.where(F.col(count) > max(least, total // HOT_KEYS)).select(*on), "hot")


def even_join(
    big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame, spread: list[str], how: str = "inner"
) -> DataFrame:
    """``big`` joined with ``small`` (one row per key); rows of hot keys are dealt over as many salts as there are partitions.

    ``hot`` are keys of bounded number (see ``hot_keys``), ``spread`` columns of ``big`` that tell rows of one key
    apart. ``how`` is inner or left.
    """
    salts = partitions(big.sparkSession)
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    every = F.expr(f"CASE WHEN _hot THEN sequence(0L, {salts - 1}L) ELSE array(0L) END")
    left = big.join(marked, on, "left").withColumn("_salt", salt).drop("_hot")
    right = small.join(marked, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")

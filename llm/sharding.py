"""Shards for rows by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size: it starts at ``offset`` and
goes on by ``skip``. Shards take turns, each claiming the first free slot in its order, until the table
is full; so all shards hold the same number of slots, give or take one, and when a shard leaves, few
slots but its own change hands. The table has ``slots`` rows whatever the data; it is broadcast, and a
row is placed by one look-up of its key's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sharding:
    """Shard names and the table's size: a prime, at least a hundred times the shards for an even spread."""

    shards: tuple[str, ...] = tuple(f"shard-{k:03d}" for k in range(64))
    slots: int = 65_537

    def __post_init__(self):
        if not self.shards or len(set(self.shards)) != len(self.shards):
            raise ValueError("shards must have different names")
        if self.slots < max(2, len(self.shards)) or any(self.slots % k == 0 for k in range(2, int(self.slots**0.5) + 1)):
            raise ValueError("slots must be a prime, no less than the number of shards")


def _digest(name: str, seed: str) -> int:
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int) -> list[int]:
    """The number of the shard that holds each slot."""
    place = [_digest(name, "offset") % slots for name in shards]
    skip = [_digest(name, "skip") % (slots - 1) + 1 for name in shards]
    table = [-1] * slots
    left = slots
    while True:
        for shard in range(len(shards)):
            at = place[shard]
            while table[at] >= 0:
                at = (at + skip[shard]) % slots
            table[at] = shard
            place[shard] = (at + skip[shard]) % slots
            left -= 1
            if left == 0:
                return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: 60 bits of its MD5 modulo the table size; null has the slot of the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def lookup_table(spark: SparkSession, settings: Sharding) -> DataFrame:
    """(slot, shard_no, shard), one row a slot, made from a literal."""
    numbers = ",".join(map(str, fill(settings.shards, settings.slots)))
    names = F.array(*[F.lit(x) for x in settings.shards])
    return (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(numbers), ",")).alias("slot", "n"))
        .select(F.col("slot").cast("long"), F.col("n").cast("long").alias("shard_no"))
        .withColumn("shard", F.get(names, F.col("shard_no").cast("int")))
    )


def assigned(rows: DataFrame, key: str = "doc_id", settings: Sharding = Sharding()) -> DataFrame:
    """All rows and columns with ``slot``, ``shard_no`` and ``shard`` (columns of these names are replaced).

    Equal keys share a shard, in any run and on any cluster; rows with a null key share one too. Nothing
    is shuffled, so neither a hot key nor repeated rows gather anywhere. Empty tables stay empty.
    """
    kept = rows.drop("slot", "shard_no", "shard") if key not in ("slot", "shard_no", "shard") else rows
    table = F.broadcast(lookup_table(rows.sparkSession, settings).withColumnRenamed("slot", "_slot"))
    return (
        kept.withColumn("slot", slot_of(kept[f"`{key}`"], settings.slots))
        .join(table, F.col("slot") == F.col("_slot"))
        .drop("_slot")
    )


def write_shards(rows: DataFrame, folder: str, key: str = "doc_id", settings: Sharding = Sharding(), files: int = 8) -> None:
    """Parquet folders ``shard=...``; a shard's rows are dealt to ``files`` tasks by their hash."""
    out = assigned(rows, key, settings).drop("slot", "shard_no")
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c == key]), F.lit(files))
    out.repartition("shard", dealt).write.partitionBy("shard").parquet(folder)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assigned(docs).select("doc_id", "source", "n_chars", "slot", "shard_no", "shard")


def _sql(settings: Sharding) -> str:
    """Placement in SQL; the claims themselves, which SQL cannot take turns at, are checked in the tests."""
    values = ", ".join(f"({k}, '{name}')" for k, name in enumerate(settings.shards))
    return f"""
    WITH shards(shard_no, shard) AS (VALUES {values}),
    hashed AS (
      SELECT doc_id, source, n_chars,
             CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {settings.slots} AS slot
      FROM documents
    ), owner AS (
      SELECT CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS slot, CAST(unnest(l) AS BIGINT) AS shard_no
      FROM (SELECT {fill(settings.shards, settings.slots)} AS l)
    )
    SELECT doc_id, source, n_chars, slot, CAST(shard_no AS BIGINT) AS shard_no, shard
    FROM hashed JOIN owner USING (slot) JOIN shards USING (shard_no)
    """


QUERIES = {"op9_sharding": (op9_sharding, _sql(Sharding()))}

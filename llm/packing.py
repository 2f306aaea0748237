"""Documents packed into sequences of several permitted lengths by variable-capacity best fit.

Lengths are token counts with an end token. A document longer than the largest capacity is cut into
chunks of that capacity; only its last chunk may be shorter. Chunks are dealt by a hash of the
document id into groups of about ``group_rows``, and each group is packed on its own, longest first:

* a chunk goes to the open bin with the least room that still holds it;
* if none does, the bin size with the least cost per token to be held is opened: its cost over what
  it will hold, which is all of it if some shorter chunk still fits beside this one, else this chunk;
* in the end each bin is downsized to the smallest permitted length that holds its contents.

The cost of a bin is ``capacity * (1 + capacity / attention) + fixed``: tokens, attention, handling.
A group loses no more than its last, badly filled bins, some per thousand at the default size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import words as w
from llm.store import partitions, written
from llm.tasks import tidy
from llm.tokens import default_vocabulary, encoder


@dataclass(frozen=True)
class Packing:
    """Permitted lengths, ascending, and costs."""

    capacities: tuple[int, ...] = (512, 1024, 2048, 4096)
    attention: float = 16_384.0
    fixed: float = 64.0
    group_rows: int = 20_000

    def __post_init__(self):
        if not self.capacities or list(self.capacities) != sorted(set(self.capacities)) or self.capacities[0] < 1:
            raise ValueError("capacities must be positive and ascending")

    def cost(self, capacity: int) -> float:
        return capacity * (1 + capacity / self.attention) + self.fixed


def pack(lengths: np.ndarray, settings: Packing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each chunk and the capacity of each bin; no chunk is longer than a capacity."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    shortest_after = np.minimum.accumulate(lengths[order][::-1])[::-1].tolist() + [None]
    filled: list[int] = []
    opened: list[int] = []
    room: list[tuple[int, int]] = []  # of open bins, ascending
    for k, chunk in enumerate(order.tolist()):
        n = int(lengths[chunk])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            rest = shortest_after[k + 1]
            best = None
            for capacity in settings.capacities:
                if capacity >= n:
                    holds = capacity if rest is not None and n + rest <= capacity else n
                    price = settings.cost(capacity) / max(holds, 1)
                    if best is None or price < best[0]:
                        best = (price, capacity)
            free, b = best[1], len(filled)
            filled.append(0)
            opened.append(best[1])
        bins[chunk], offsets[chunk] = b, filled[b]
        filled[b] += n
        if free > n:
            insort(room, (free - n, b))
    sizes = np.array(settings.capacities)
    return bins, offsets, sizes[np.searchsorted(sizes, np.array(filled, np.int64))] if filled else np.zeros(0, np.int64)


PACKED = "doc_id long, chunk long, length long, bin_id long, bin_offset long, capacity long"


def _packed(settings: Packing):
    largest = settings.capacities[-1]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending")])
        n = table.column("n_tokens").to_numpy()
        chunks = np.maximum(1, -(-n // largest))
        row = np.repeat(np.arange(len(n)), chunks)
        number = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        length = np.minimum(largest, n[row] - number * largest)
        bins, offset, capacity = pack(length, settings)
        first = int(table.column("part")[0].as_py()) << 32
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(pa.array(row)),
                "chunk": number,
                "length": length,
                "bin_id": first + bins,
                "bin_offset": offset,
                "capacity": capacity[bins],
            }
        )

    return run


def _counted(path: str):
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for piece in w.pieces(batch, "text", 1 << 19):
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(coder.counts(piece.column("text")) + 1)], names=["doc_id", "n_tokens"]
                )

    return run


def token_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): token ids of each text and an end id; null and empty texts have just that."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(tidy(_counted(vocabulary or default_vocabulary()), keep=True), "doc_id long, n_tokens long")


def pack_lengths(lengths: DataFrame, settings: Packing = Packing()) -> DataFrame:
    """Place every row of (doc_id, n_tokens): doc_id, chunk, length, bin_id, bin_offset, capacity.

    Every chunk has one row. Null lengths count as 0 and take an empty place. Rows that share an id or
    have none are packed like others; equal lengths go by id. An empty table gives no rows.
    """
    spark = lengths.sparkSession
    kept = written(lengths.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")), "lengths")
    groups = max(1, -(-kept.count() // settings.group_rows))
    part = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(groups))
    return (
        kept.withColumn("part", part)
        .repartition(min(groups, partitions(spark)), "part")
        .groupBy("part")
        .applyInArrow(_packed(settings), PACKED)
    )


def pack_documents(docs: DataFrame, settings: Packing = Packing(), vocabulary: str | None = None) -> DataFrame:
    """Token lengths of the documents, packed."""
    return pack_lengths(token_lengths(docs, vocabulary), settings)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_best_fit_packing": (op6_best_fit_packing, None)}

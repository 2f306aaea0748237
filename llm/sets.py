"""Exact comparison of many sets of 64-bit elements inside a task, and splitting of crowded groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import words as w
from llm.store import sized_join, written


class PackedSets:
    """Rows of a binary column, each the bytes of ascending distinct unsigned 64-bit elements."""

    def __init__(self, column: pa.ChunkedArray):
        packed = column.combine_chunks()
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        self.element = np.frombuffer(packed.buffers()[2] or b"", np.uint64)
        self.start = offsets[:-1].astype(np.int64) // 8
        self.size = np.diff(offsets.astype(np.int64)) // 8

    def _elements(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[rows]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[rows], n)
        return n, self.element[at]

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pairs, by merging them some at a time."""
        out = np.zeros(len(x), np.int64)
        starts, counts = w.runs(np.cumsum(self.size[x] + self.size[y]) // 2_000_000)
        for lo, hi in zip(starts, starts + counts):
            n, element = self._elements(np.concatenate([x[lo:hi], y[lo:hi]]))
            half = hi - lo
            pair = np.repeat(np.r_[np.arange(half), np.arange(half)], n)
            order = w.sort_in_groups(pair, element)
            pair, element = pair[order], element[order]
            twice = np.flatnonzero((pair[1:] == pair[:-1]) & (element[1:] == element[:-1]))
            out[lo:hi] = np.bincount(pair[twice], minlength=half)
        return out

    def products(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of each row of ``one`` with each of ``two``; some hundred rows each."""
        n, element = self._elements(np.concatenate([one, two]))
        owner = np.repeat(np.arange(len(n)), n)
        known, column, times = np.unique(element, return_inverse=True, return_counts=True)
        several = times > 1
        column, owner = (np.cumsum(several) - 1)[column][several[column]], owner[several[column]]
        shared = np.zeros((len(one), len(two)), np.float32)
        width = int(several.sum())
        for low in range(0, width, 16_384):
            inside = (column >= low) & (column < low + 16_384)
            present = np.zeros((len(n), min(16_384, width - low)), np.float32)
            present[owner[inside], column[inside] - low] = 1
            shared += present[: len(one)] @ present[len(one) :].T
        return np.rint(shared).astype(np.int64)


def whole_keys(batches, rows: int):
    """Tables of about ``rows`` rows that end where a key ends; the input is sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield table.slice(0, last).combine_chunks()
            held, n = table.slice(last).to_batches(), table.num_rows - last
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def split_crowds(rows: DataFrame, block_rows: int, *member: str, of: DataFrame | None = None) -> DataFrame:
    """Keys of more than ``block_rows`` rows become one key for each pair of blocks of their rows.

    Adds ``left``, a row's block, and ``apart``, whether a row is here to be compared with the other
    block only; all pairs of a key still meet exactly once. ``member`` are columns that tell rows apart;
    ``of`` has the same keys as often and is cheaper to count.
    """
    crowded = written((rows if of is None else of).groupBy("key").count().where(F.col("count") > block_rows), "crowded")
    return (
        sized_join(rows, crowded, ["key"], "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("count") / block_rows), F.lit(1)).cast("long"))
        .withColumn("left", F.pmod(F.xxhash64(*member), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn(
            "key",
            F.when(F.col("blocks") == 1, F.col("key")).otherwise(
                F.xxhash64("key", F.least("left", "other"), F.greatest("left", "other"))
            ),
        )
        .withColumn("apart", F.col("other") != F.col("left"))
        .drop("count", "blocks", "other")
    )

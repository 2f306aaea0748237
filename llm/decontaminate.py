"""Benchmark passages in documents, by the q-gram lemma in diagonal bands and banded alignment.

Texts are compared in lower case with white space as single blanks. An item of n characters occurs
in a document if some stretch of it is within ``k = floor(budget * n)`` edits of the item. By the
q-gram lemma such a stretch shares at least ``n - q + 1 - k * q`` q-grams with the item, all on
diagonals (document place minus item place) at most k apart.

One pass per block of items: every q-gram of the document is looked up in a table of the block's
q-grams; a place without a window of many hits in reach is left at once, as no item can lie there; all hits of the others are counted
per item in bands of diagonals, each overlapping the next by half; bands that reach the item's
bound are verified by an alignment within the band.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import words as w
from llm.store import BROADCAST_ELEMENTS, BROADCAST_ROWS, written
from llm.tasks import tidy


@dataclass(frozen=True)
class Decontamination:
    """Settings. A block of items holds up to ``block_chars`` characters (or one item)."""

    q: int = 8
    budget: float = 0.08
    block_chars: int = 2_000_000

    def edits(self, n: int) -> int:
        """The edit budget of an item: at most so much that one shared q-gram is still required."""
        return max(0, min(int(self.budget * n), (n - self.q) // self.q))

    def bound(self, n: int) -> int:
        """Shared q-grams that a stretch within the budget has."""
        return n - self.q + 1 - self.q * self.edits(n)


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower case of each code point where it is one code point; white space as a blank."""
    table = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x1E944):
        small = chr(code).lower()
        if len(small) == 1:
            table[code] = ord(small)
        if chr(code).isspace():
            table[code] = 0x20
    return table


def folded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in compared form, and the offsets of the texts in them."""
    starts = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets]
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(codes) != starts[-1]:  # broken UTF-8: one text at a time
        parts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        starts = np.r_[0, np.cumsum([len(x) for x in parts])]
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    codes = _folded()[codes]
    blank = codes == 0x20
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    inner = starts[1:-1]
    inner = inner[inner < len(codes)]
    keep[inner] = True
    return codes[keep], np.r_[0, np.cumsum(keep)][starts]


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit value of each run of q code points."""
    n = max(0, len(codes) - q + 1)
    value = np.zeros(n, np.uint32)
    for i in range(q):
        value *= np.uint32(0x01000193)
        value += codes[i : i + n]
    return value * np.uint32(0x9E3779B1)


TABLE_BITS = 20


class _Block:
    """The items of one block, with their q-grams ready for look-up."""

    def __init__(self, items: list[tuple[int, str]], settings: Decontamination):
        self.settings, self.items, q = settings, [], settings.q
        grams, owner, place = [], [], []
        self.short: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            data = np.frombuffer(text.encode("utf-8"), np.uint8)
            codes = folded(data, np.array([0, len(data)]))[0]
            codes = codes[1:] if len(codes) and codes[0] == 0x20 else codes
            codes = codes[:-1] if len(codes) and codes[-1] == 0x20 else codes
            if len(codes) == 0:
                continue
            if len(codes) < q:
                self.short.append((item, codes))
                continue
            value = _grams(codes, q)
            grams.append(value)
            owner.append(np.full(len(value), len(self.items)))
            place.append(np.arange(len(value)))
            self.items.append((item, codes))
        size = np.array([len(c) for _, c in self.items], np.int64)
        self.edits = np.array([settings.edits(n) for n in size], np.int64)
        self.bound = size - q + 1 - q * self.edits
        self.size = size
        if self.items:
            grams, owner, place = np.concatenate(grams), np.concatenate(owner), np.concatenate(place)
            order = np.lexsort((place, owner, grams))
            self.grams, self.owner, self.place = grams[order], owner[order], place[order]
            self.table = np.zeros(1 << TABLE_BITS, bool)
            self.table[self.grams >> np.uint32(32 - TABLE_BITS)] = True
            # A stretch of n + k characters lies in so many windows; one has its share of the hits. All
            # other hits of the stretch are within its length of that window.
            self.window = 64
            self.reach = int(np.max(size + self.edits))
            self.least = int(np.min(-(-self.bound // -(-(size + self.edits) // self.window))))

    def find(self, codes: np.ndarray, starts: np.ndarray):
        """(text, item, start, end, edits) of every occurrence: the best one of each band of each item."""
        found = []
        for item, short in self.short:
            needle = short.tobytes()
            for t, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                at = codes[a:b].tobytes().find(needle)
                while at >= 0 and at % 4:
                    at = codes[a:b].tobytes().find(needle, at + 1)
                if at >= 0:
                    found.append((t, item, at // 4, at // 4 + len(short), 0))
        if not self.items or len(codes) < self.settings.q:
            return found
        value = _grams(codes, self.settings.q)
        hit = self.table[value >> np.uint32(32 - TABLE_BITS)]
        total = np.zeros(len(hit) + 1 + self.window, np.int32)
        np.cumsum(hit, out=total[1 : len(hit) + 1])
        total[len(hit) + 1 :] = total[len(hit)]
        rich = np.flatnonzero(total[self.window :] - total[: -self.window] >= self.least)
        if not len(rich):
            return found
        cover = np.zeros(len(hit) + 1, np.int32)
        np.add.at(cover, np.minimum(np.maximum(rich - self.reach, 0), len(hit)), 1)
        np.add.at(cover, np.minimum(rich + self.window + self.reach, len(hit)), -1)
        at = np.flatnonzero(hit & (np.cumsum(cover)[: len(hit)] > 0))
        text = np.searchsorted(starts, at, side="right") - 1
        inside = at + self.settings.q <= starts[text + 1]
        at, text = at[inside], text[inside]
        low = np.searchsorted(self.grams, value[at], side="left")
        n = np.searchsorted(self.grams, value[at], side="right") - low
        entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, text = np.repeat(at, n), np.repeat(text, n)
        item = self.owner[entry]
        diagonal = at - self.place[entry]
        width = self.edits[item] + 1
        band = np.floor_divide(diagonal, width)
        # Band b covers the diagonals of b and b + 1, so any two at most k apart share a band.
        text, item, band, at = (np.concatenate([x, x]) for x in (text, item, band, at))
        band[len(band) // 2 :] -= 1
        order = np.lexsort((at, band, item, text))
        text, item, band, at = text[order], item[order], band[order], at[order]
        new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])]
        once = np.r_[True, new[1:] | (at[1:] != at[:-1])]
        group = np.flatnonzero(new)
        hits = np.add.reduceat(once.astype(np.int64), group)
        full = group[hits >= self.bound[item[group]]]
        best: dict[tuple[int, int], tuple] = {}
        for g in full:
            t, i = int(text[g]), int(item[g])
            k = int(self.edits[i])
            low = int(band[g]) * (k + 1)
            a = max(int(starts[t]), low - k)
            b = min(int(starts[t + 1]), low + 2 * (k + 1) + int(self.size[i]) + k)
            match = banded(self.items[i][1], codes[a:b], k)
            if match:
                start, end, edits = match
                row = (edits, a - int(starts[t]) + start, a - int(starts[t]) + end)
                key = (t, i)
                if key not in best or row < best[key]:
                    best[key] = row
        found += [(t, self.items[i][0], start, end, edits) for (t, i), (edits, start, end) in best.items()]
        return found


def banded(item: np.ndarray, stretch: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """The place in ``stretch`` nearest to the item and its edits, None beyond k.

    Rows are the item's characters; the stretch is no wider than the item and its band of diagonals,
    so each row is one vector step. The start is free, and so is the end.
    """
    at = stretch.tobytes().find(item.tobytes())
    if at >= 0 and at % 4 == 0:
        return at // 4, at // 4 + len(item), 0
    n = len(stretch)
    steps = np.arange(n + 1)
    score, origin = np.zeros(n + 1, np.int64), steps.copy()
    for i, c in enumerate(item, 1):
        other = (stretch != c).astype(np.int64)
        cost = score + 1
        source = origin.copy()
        across = score[:-1] + other
        better = across < cost[1:]
        cost[1:] = np.where(better, across, cost[1:])
        source[1:] = np.where(better, origin[:-1], source[1:])
        flat = (cost - steps) * (n + 2) + steps
        kept = np.minimum.accumulate(flat)
        from_ = kept % (n + 2)
        score, origin = kept // (n + 2) + steps, source[from_]
        if score.min() > k:
            return None
    end = int(score.argmin())
    return (int(origin[end]), end, int(score[end])) if score[end] <= k else None


MATCHES = "id long, item_id long, start long, end long, edits long"


def _scanned(block):
    def run(batches):
        for batch in batches:
            for piece in w.pieces(batch, "text"):
                codes, starts = folded(*w.utf8(piece.column("text")))
                rows = block.value.find(codes, starts)
                ids = piece.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array([r[c] for r in rows], pa.int64()) for c in range(1, 5))],
                    names=["id", "item_id", "start", "end", "edits"],
                )

    return run


def _blocks(benchmark: DataFrame, settings: Decontamination):
    """Blocks of items of bounded size; one block at a time is in the driver."""
    held, chars = [], 0
    for row in benchmark.toLocalIterator():
        if row["text"] is None or row["item_id"] is None:
            continue
        held.append((row["item_id"], row["text"]))
        chars += len(row["text"])
        if chars >= settings.block_chars:
            yield held
            held, chars = [], 0
    if held:
        yield held


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    settings: Decontamination = Decontamination(),
) -> DataFrame:
    """(id, item_id, start, end, edits): the best occurrence of each item in each document.

    ``start`` and ``end`` count characters of the compared form. Items that are null or have no
    character but white space are found nowhere; items shorter than q are found as they are. Null
    and empty texts and rows with a null id have no occurrence.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where(
        "id is not null and text is not null"
    )
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    out = None
    for block in _blocks(items, settings):
        shared = spark.sparkContext.broadcast(_Block(block, settings))
        part = written(texts.mapInArrow(tidy(_scanned(shared)), MATCHES), "occurrences")
        shared.destroy()
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], MATCHES) if out is None else out


def flagged(docs: DataFrame, benchmark: DataFrame, settings: Decontamination = Decontamination()) -> DataFrame:
    """The documents with ``contaminated`` and ``matches`` (item_id, start, end, edits; by item).

    All rows and other columns stay; columns of these two names are replaced. Rows that share an id
    get the matches of all of them.
    """
    found = written(
        occurrences(docs, benchmark, settings=settings)
        .groupBy(F.col("id").alias("_found_id"))
        .agg(F.array_sort(F.collect_list(F.struct("item_id", "start", "end", "edits"))).alias("matches")),
        "found",
    )
    docs = docs.drop("matches", "contaminated")
    few = found.agg(F.sum(F.size("matches"))).first()[0] or 0
    joined = docs.join(
        F.broadcast(found) if few <= BROADCAST_ELEMENTS else found,
        docs["doc_id"].cast("long") == found["_found_id"],
        "left",
    )
    return joined.select(
        *docs.columns,
        F.col("matches").isNotNull().alias("contaminated"),
        F.coalesce("matches", F.array().cast("array<struct<item_id:bigint,start:bigint,end:bigint,edits:bigint>>")).alias(
            "matches"
        ),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, settings: Decontamination = Decontamination()) -> DataFrame:
    """The documents without any occurrence of an item; all their columns stay as they are."""
    found = written(
        occurrences(docs, benchmark, settings=settings).select(F.col("id").alias("_found_id")).distinct(), "found"
    )
    small = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return docs.join(small, docs["doc_id"].cast("long") == small["_found_id"], "left_anti")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = flagged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", F.size("matches").cast("long").alias("n_items"), "matches")


QUERIES = {"op4_benchmark_decontamination": (op4_benchmark_decontamination, None)}

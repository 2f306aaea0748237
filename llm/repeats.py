"""Removal of byte strings that occur more than once, by bucket-pointer refinement of their suffixes.

A string of ``length`` bytes that starts at two places must agree there in every q-gram it holds, also in the
one with the least hash (the leftmost of equal ones). So a place takes part only with the least gram of its
window: successive windows with the same least gram make one occurrence, about one for every 35 bytes. These grams
are the initial buckets; a bucket with one member is done. Members with equal surroundings (all their
windows alike) are done too: all repeat. What is left in a bucket differs somewhere in its windows, mostly near
the ends of a repeat, and is refined: the suffixes of the members' surroundings are put into buckets by their
first 8 bytes, and buckets with several members are sorted on the pair of their own bucket and that of
a later offset, again and again, each round reusing the buckets of the one before, until the buckets stand for
``length`` bytes.

A bucket of very many members never goes into one task: its windows are halved by how far they reach to the left of the gram,
which gives either half more bytes in common, and each half is bucketed anew by these bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm import words as w
from llm.rolling import Rolling
from llm.sets import whole_keys
from llm.skew import even_join, hot_keys
from llm.store import drop, written
from llm.tasks import tidy

#: Texts are read in blocks of so many windows.
BLOCK = 1 << 19
#: Buckets of more members are halved.
CROWD = 4096


@dataclass(frozen=True)
class RepeatRules:
    """Strings of ``length`` bytes that start twice go; ``gram`` is the size of the initial buckets' grams."""

    length: int = 200
    gram: int = 128

    @property
    def reach(self) -> int:
        """How many places a window may start before its gram, at most."""
        return self.length - self.gram


def least_in_windows(value: np.ndarray, width: int) -> np.ndarray:
    """The position of the least value (the leftmost of equal ones) of each run of ``width`` values."""
    best, at, size = value, np.arange(len(value)), 1
    while size < width:
        step = min(size, width - size)
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        size += step
    return at


def occurrences(raw: np.ndarray, offsets: np.ndarray, rules: RepeatRules):
    """The occurrences of some texts, which ``offsets`` cut ``raw`` into, in order of place.

    Their texts, grams, surroundings, starts in the text, numbers of windows, and distances to the gram.
    """
    hashes = Rolling(raw)
    first = np.arange(len(raw) - rules.gram + 1)
    at = least_in_windows(hashes.of(first, first + rules.gram), rules.reach + 1)
    windows = np.maximum(np.diff(offsets) - rules.length + 1, 0)
    text = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[text]
    at = at[place]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[new, len(at)])
    start, at, text = place[new], at[new], text[new]
    off = at - start
    around = hashes.of(start, start + count - 1 + rules.length) ^ w.mix(off.astype(np.uint64) + np.uint64(1))
    return text, hashes.of(at, at + rules.gram), around, start - offsets[text], count, off


OCCURRENCE = "gram long, around long, row binary, start long, n int, off int"


def _blocks(batches: Iterator[pa.RecordBatch], rules: RepeatRules):
    """(rows, bytes, offsets, how far into its text the first one starts): whole short texts together, long ones in blocks."""
    for batch in batches:
        for piece in w.pieces(batch, "text"):
            raw, offsets = w.utf8(piece.column("text"))
            if len(raw) <= 2 * BLOCK:
                yield piece.column("row"), raw, offsets, 0
                continue
            for i, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                for low in range(start, end - rules.length + 1, BLOCK):
                    part = raw[low : min(low + BLOCK + rules.length - 1, end)]
                    yield piece.column("row").slice(i, 1), part, np.array([0, len(part)]), low - start


def _scan(rules: RepeatRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets, low in _blocks(batches, rules):
            if len(raw) < rules.length or (np.diff(offsets) < rules.length).all():
                continue
            text, gram, around, start, n, off = occurrences(raw, offsets, rules)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram.view(np.int64)),
                    pa.array(around.view(np.int64)),
                    rows.take(pa.array(text)),
                    pa.array(low + start),
                    pa.array(n.astype(np.int32)),
                    pa.array(off.astype(np.int32)),
                ],
                names=["gram", "around", "row", "start", "n", "off"],
            )

    return run


CONTEXT = "key long, gram long, low int, high int, row binary, start long, n int, off int, weight int, bytes binary"


def _contexts(rules: RepeatRules):
    """Cuts the surroundings that were asked for out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, row, asks in zip(batch.column("text"), batch.column("row"), batch.column("asks")):
                data = memoryview(text.as_buffer())
                asks = pa.RecordBatch.from_struct_array(asks.values)
                start, n = asks.column("start").to_numpy(), asks.column("n").to_numpy()
                m = len(start)
                cut = [bytes(data[a:b]) for a, b in zip(start.tolist(), (start + n - 1 + rules.length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        asks.column("gram"),
                        asks.column("gram"),
                        pa.array(np.zeros(m, np.int32)),
                        pa.array(np.full(m, rules.reach, np.int32)),
                        pa.array([row.as_py()] * m, pa.binary()),
                        asks.column("start"),
                        asks.column("n"),
                        asks.column("off"),
                        asks.column("weight"),
                        pa.array(cut, pa.binary()),
                    ],
                    names=["key", "gram", "low", "high", "row", "start", "n", "off", "weight", "bytes"],
                )

    return run


def _halved(rules: RepeatRules):
    """Members with their windows in two halves, each keyed by the bytes that its windows have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                middle = (x["low"] + x["high"]) // 2
                for low, high in ((x["low"], middle), (middle + 1, x["high"])):
                    least, most = max(low, x["off"] - x["n"] + 1), min(high, x["off"])
                    if least > most:
                        continue
                    skip = x["off"] - most
                    data = x["bytes"][skip : skip + most - least + rules.length]
                    common = np.frombuffer(data[most - low : most + rules.length - high], np.uint8)
                    key = Rolling(common).of(np.zeros(1, int), np.array([len(common)]))
                    key = w.mix(key ^ np.uint64(low << 20 | high)).view(np.int64)[0]
                    out.append(x | {
                        "key": int(key), "low": low, "high": high, "start": x["start"] + skip,
                        "n": most - least + 1, "off": most, "bytes": data,
                    })
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return run


def refined(raw: np.ndarray, length: int, wanted: np.ndarray) -> np.ndarray:
    """Buckets of the suffixes at the places ``wanted`` by their first ``length`` bytes: equal numbers for equal strings.

    Initial buckets are 8-grams. Each round sorts the members of buckets with several ones on (bucket, bucket at
    a later offset); the others keep theirs, which tells them apart already. A round leaves out the
    places that no wanted one reaches in the rounds to come. Suffixes that are too short get some bucket.
    """
    n = len(raw)
    steps, depth = [], 8
    while depth < length:
        steps.append(min(depth, length - depth))
        depth += steps[-1]
    needed = [np.zeros(n, bool) for _ in range(len(steps) + 1)]
    needed[-1][wanted] = True
    for i in range(len(steps) - 1, -1, -1):
        needed[i] |= needed[i + 1]
        needed[i][steps[i] :] |= needed[i + 1][: n - steps[i]]
    grams = np.zeros(n, np.uint64)
    padded = np.r_[raw, np.zeros(8, np.uint8)].astype(np.uint64)
    for i in range(8):
        grams = (grams << np.uint64(8)) | padded[i : i + n]
    bucket = np.zeros(n, np.int64)
    bucket[needed[0]] = np.unique(grams[needed[0]], return_inverse=True)[1]
    for step, places in zip(steps, needed[1:]):
        size = np.bincount(bucket)
        several = np.flatnonzero(places & (size[bucket] > 1))
        if len(several) == 0:
            break
        later = bucket[np.minimum(several + step, n - 1)]
        bucket[several] = len(size) + np.unique(bucket[several] * len(size) + later, return_inverse=True)[1]
    return bucket[wanted]


def _refine(rules: RepeatRules):
    """Whole buckets of occurrences -> the runs of windows of each member that another window equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, CROWD):
            data = table.column("bytes").combine_chunks()
            raw, offsets = w.utf8(data.cast(pa.large_binary()).view(pa.large_string()))
            n = table.column("n").to_numpy()
            member = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
            window = refined(raw, rules.length, offsets[:-1][member] + inside)
            weight = np.bincount(window, weights=table.column("weight").to_numpy()[member])
            twice = weight[window] > 1
            if not twice.any():
                continue
            place = np.flatnonzero(twice)
            new = np.r_[True, (np.diff(place) > 1) | (np.diff(member[place]) > 0)]
            first = place[new]
            size = np.diff(np.r_[np.flatnonzero(new), len(place)])
            at = member[first]
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("row").combine_chunks().take(pa.array(at)),
                    pa.array(table.column("start").to_numpy()[at] + inside[first]),
                    pa.array(size.astype(np.int32)),
                ],
                names=["row", "start", "n"],
            )

    return run


def _spread(members: DataFrame, rules: RepeatRules) -> DataFrame:
    """The members (a written table) with all crowded buckets halved until none is left, or its windows are single."""
    while True:
        counts = members.where("low < high").groupBy("key").count()
        crowded = written(counts.where(F.col("count") > CROWD).select("key"), "crowded")
        if crowded.isEmpty():
            drop(members.sparkSession, crowded)
            return members
        few = F.broadcast(crowded)
        hot = members.where("low < high").join(few, "key", "left_semi").select(*members.columns)
        rest = members.join(few.withColumn("_c", F.lit(True)), "key", "left").where("_c IS NULL OR low = high")
        halves = hot.mapInArrow(_halved(rules), CONTEXT)
        after = written(rest.select(*members.columns).unionAll(halves), "members")
        drop(members.sparkSession, members, crowded)
        members = after


def _row_of(key: str):
    """A row's identity: its text and its key. Rows equal in both have the same outcome."""
    return F.unhex(F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit("\0"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0")))))


def repeated_windows(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """(row, starts): where in each row's text a string of the given length starts that also starts elsewhere.

    ``docs`` has row and text; ``starts`` are runs (start, n) of places. Rows without such a place are left out.
    """
    spark = docs.sparkSession
    found = docs.where(F.octet_length("text") >= rules.length).mapInArrow(tidy(_scan(rules)), OCCURRENCE)
    grams = found.groupBy("gram").agg(
        F.count("*").alias("members"), (F.min("around") < F.max("around")).alias("mixed")
    )
    grams = written(grams.where("members > 1"), "grams")
    hot = hot_keys(grams, ["gram"], "members")
    met = written(even_join(found, grams.select("gram", "mixed"), ["gram"], hot, ["row", "start"]), "met")

    one = F.struct("row", "start", "n", "off")
    alike = met.where("mixed").groupBy("gram", "around").agg(F.count("*").alias("c"), F.min(one).alias("one"))
    alike = written(alike, "alike")
    hot_alike = hot_keys(alike, ["gram", "around"], "c")
    same = even_join(met.where("mixed"), alike.where("c > 1").select("gram", "around"), ["gram", "around"], hot_alike, ["row", "start"])

    ask = F.struct("gram", F.col("one.start").alias("start"), F.col("one.n").alias("n"), F.col("one.off").alias("off"), F.least("c", F.lit(2)).cast("int").alias("weight"))
    asks = alike.groupBy(F.col("one.row").alias("row")).agg(F.collect_list(ask).alias("asks"))
    cut = docs.join(asks, "row").mapInArrow(tidy(_contexts(rules)), CONTEXT)
    members = _spread(written(cut, "members"), rules)
    several = members.where("low < high").repartition("key").sortWithinPartitions("key")
    by_bytes = several.mapInArrow(tidy(_refine(rules)), "row binary, start long, n int")
    single = members.where("low = high").drop("bytes", "low", "high")
    weights = written(single.groupBy("key", "gram").agg(F.sum("weight").alias("c")), "weights")
    hot_single = hot_keys(weights, ["key", "gram"], "c")
    exact = even_join(single, weights.where("c > 1").drop("c"), ["key", "gram"], hot_single, ["row", "start"])

    runs = met.where("NOT mixed").select("row", "start", "n")
    for more in (same, by_bytes, exact):
        runs = runs.unionByName(more.select("row", "start", "n"))
    starts = runs.groupBy("row", "start").agg(F.max("n").alias("n"))
    result = written(starts.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("starts")), "starts")
    drop(spark, grams, hot, met, alike, hot_alike, members, weights, hot_single)
    return result


def _cut(rules: RepeatRules):
    """The spans that the repeated strings of a text cover, and the bytes outside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for x in batches for piece in w.pieces(x, "text", BLOCK)):
            sizes, spans, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                sizes.append(len(data))
                if not starts.is_valid:
                    spans.append([])
                    kept.append(bytes(data))
                    continue
                runs = pa.RecordBatch.from_struct_array(starts.values)
                low = runs.column("start").to_numpy()
                order = np.argsort(low, kind="stable")
                low = low[order]
                high = np.maximum.accumulate(low + runs.column("n").to_numpy()[order] - 1 + rules.length)
                new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
                low, high = low[new], high[np.r_[new[1:] - 1, len(high) - 1]]
                spans.append([{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist())])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(data)])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=["key", "n_bytes", "spans", "kept"],
            )

    return run


def without_repeats(docs: DataFrame, key: str, rules: RepeatRules = RepeatRules()) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, the removed ``spans`` [start, end) in bytes, and the bytes ``kept``.

    A byte goes if a string of ``rules.length`` bytes over it also starts at another place of any text, its own
    included; what goes is judged on the texts as they come. Copies thus go whole, the first one too. Null and empty
    texts, and those shorter than that, keep all. Rows with equal key and text have equal outcomes; null and
    equal keys matter not. Other columns are left out. An empty table gives no rows.
    """
    kind = docs.schema[key].dataType
    source = docs.select(F.col(f"`{key}`").alias("key"), "text", _row_of(key).alias("row"))
    starts = repeated_windows(source.select("row", "text"), rules)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span),
        T.StructField("kept", T.BinaryType()),
    ])
    out = source.join(starts, "row", "left").select("key", "text", "starts").mapInArrow(tidy(_cut(rules)), schema)
    return out.withColumnRenamed("key", key)


def op12_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return without_repeats(docs, "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op12_repeat_removal": (op12_repeat_removal, None)}

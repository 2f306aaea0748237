"""Near-duplicate documents: MinHash signatures, banding, verification, connected components.

1. One pass makes each document's set of word shingles, its digest and its signature: the minima of
   ``bands * rows`` universal hash functions. Documents with equal sets are one class from here on.
2. Classes that agree in a band meet in a bucket. A bucket is not expanded into pairs: its classes
   are first compared with one pivot, by signature and then by the full sets, which are made again from
   the texts of the classes concerned. So a bucket of n near copies costs about n comparisons.
3. Only classes of one bucket that are in different components then are compared further: inside
   the bucket, set by set, a crowded one in pairs of blocks. One link leaves it for two components.
4. Large-star and small-star steps turn links into components.

With the defaults (32 bands of 5) two documents of similarity 0.8 miss each other in all bands with
a probability of 3e-6; the signature test, six deviations below 0.8, drops fewer than one in 10^8.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import words as w
from llm.graph import components
from llm.rows import numbered
from llm.sets import PackedSets, split_crowds, whole_keys
from llm.skew import even_join, hot_keys
from llm.store import BROADCAST_ROWS, drop, partitions, sized_join, written
from llm.tasks import tidy


@dataclass(frozen=True)
class MinHash:
    """Settings. ``numerator / denominator`` is the least similarity that links two documents."""

    shingle: int = 5
    numerator: int = 80
    denominator: int = 100
    bands: int = 32
    rows: int = 5
    seed: int = 1
    block_rows: int = 2048

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreement(self) -> int:
        """Signature places that must agree: six standard deviations below the expected number."""
        p = self.numerator / self.denominator
        return max(0, int(self.hashes * p - 6 * (self.hashes * p * (1 - p)) ** 0.5))


def shingles(text: w.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of each distinct run of ``size`` words; a shorter text is one shingle."""
    n, h = len(text.hashes), text.hashes
    at = np.arange(n)
    last = np.repeat(text.first + text.count, text.count)
    short = np.flatnonzero((text.count > 0) & (text.count < size))
    start = at[at + size <= last]
    value = np.zeros(len(start), np.uint64)
    for i in range(size):
        value = w.mix(value + h[start + i] * np.uint64(2 * i + 3))
    whole = np.zeros(len(short), np.uint64)
    for i in range(size - 1):
        more = text.count[short] > i
        whole[more] = w.mix(whole[more] + h[text.first[short[more]] + i] * np.uint64(2 * i + 3))
    whole = w.mix(whole ^ np.uint64(0x5851F42D4C957F2D) ^ text.count[short].astype(np.uint64))
    return w.distinct_in_groups(np.r_[text.text[start], short], np.r_[value, whole])


def _signed(settings: MinHash):
    random = np.random.default_rng(settings.seed)
    factors = random.integers(0, 1 << 32, settings.hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    shifts = random.integers(0, 1 << 32, settings.hashes, dtype=np.uint64).astype(np.uint32)
    weights = random.integers(0, 1 << 63, settings.rows, dtype=np.uint64) | np.uint64(1)
    schema = pa.schema(
        [
            ("id", pa.int64()),
            ("n_shingles", pa.int64()),
            ("digest_a", pa.int64()),
            ("digest_b", pa.int64()),
            ("signature", pa.binary()),
            ("keys", pa.list_(pa.int64())),
        ]
    )

    def run(batches):
        for batch in batches:
            for piece in w.pieces(batch, "text"):
                text = w.Words(piece.column("text"))
                owner, value = shingles(text, settings.shingle)
                starts, counts = w.runs(owner)
                n = np.zeros(len(text.first), np.int64)
                n[owner[starts]] = counts
                digests = np.zeros((2, len(n)), np.uint64)
                signature = np.zeros((len(n), settings.hashes), np.uint32)
                keys = np.zeros((len(n), settings.bands), np.uint64)
                if len(starts):
                    here = owner[starts]
                    digests[0, here] = np.add.reduceat(value, starts)
                    digests[1, here] = np.add.reduceat(w.mix(value), starts)
                    high = (value >> np.uint64(32)).astype(np.uint32)
                    low = np.empty((settings.hashes, len(here)), np.uint32)
                    for j in range(settings.hashes):
                        low[j] = np.minimum.reduceat(high * factors[j] + shifts[j], starts)
                    signature[here] = low.T
                    banded = signature.reshape(len(n), settings.bands, settings.rows)
                    for j in range(settings.rows):
                        keys = w.mix(keys + banded[:, :, j] * weights[j])
                    keys += np.arange(settings.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    keys = w.mix(keys)
                size = 4 * settings.hashes
                ends = np.cumsum(np.r_[0, np.where(n > 0, size, 0)]).astype(np.int32)
                key_ends = np.cumsum(np.r_[0, np.where(n > 0, settings.bands, 0)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id"),
                        pa.array(n),
                        pa.array(digests[0].view(np.int64)),
                        pa.array(digests[1].view(np.int64)),
                        pa.Array.from_buffers(
                            pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(signature[n > 0].tobytes())]
                        ),
                        pa.ListArray.from_arrays(pa.array(key_ends), pa.array(keys[n > 0].ravel().view(np.int64))),
                    ],
                    schema=schema,
                )

    return run


SIGNED = "id long, n_shingles long, digest_a long, digest_b long, signature binary, keys array<long>"


def _sets(size: int):
    """(rep, set): the ascending shingle hashes of each text, as bytes."""

    def run(batches):
        for batch in batches:
            for piece in w.pieces(batch, "text"):
                text = w.Words(piece.column("text"))
                owner, value = shingles(text, size)
                ends = np.searchsorted(owner, np.arange(len(text.first) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id"),
                        pa.Array.from_buffers(
                            pa.large_binary(), len(text.first), [None, pa.py_buffer(8 * ends), pa.py_buffer(value.tobytes())]
                        ).cast(pa.binary()),
                    ],
                    names=["rep", "set"],
                )

    return run


def _agreeing(least: int):
    """Pairs whose signatures agree in at least ``least`` places."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                for c in ("signature_a", "signature_b")
            )
            yield batch.select(["a", "b"]).filter(pa.array((one == two).sum(axis=1) >= least))

    return run


def overlap(one: bytes, two: bytes) -> tuple[int, int]:
    """Sizes of the intersection and the union of two packed sets."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return both, len(a) + len(b) - both


def _similar(numerator: int, denominator: int):
    """Pairs whose full sets reach the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b")):
                both, either = overlap(one.as_py(), two.as_py())
                keep.append(denominator * both >= numerator * either)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, signed: DataFrame, docs: DataFrame, settings: MinHash) -> DataFrame:
    """The pairs (a, b) of class representatives that are similar: by signature first, then by set."""
    spark = pairs.sparkSession
    sides = signed.select("id", "signature")
    likely = written(
        pairs.join(sides.select(F.col("id").alias("a"), F.col("signature").alias("signature_a")), "a")
        .join(sides.select(F.col("id").alias("b"), F.col("signature").alias("signature_b")), "b")
        .mapInArrow(tidy(_agreeing(settings.least_agreement)), "a long, b long"),
        "likely",
    )
    concerned = written(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "concerned")
    sets = written(
        sized_join(docs, concerned, ["id"], "left_semi").mapInArrow(tidy(_sets(settings.shingle)), "rep long, set binary"),
        "sets",
    )
    links = written(
        likely.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
        .mapInArrow(tidy(_similar(settings.numerator, settings.denominator)), "a long, b long"),
        "similar",
    )
    drop(spark, likely, concerned, sets)
    return links


def _tying(settings: MinHash):
    """Links between members of different parts of a bucket: one for each two parts that any pair ties."""
    numerator, denominator = settings.numerator, settings.denominator

    def run(batches):
        for table in whole_keys(batches, 4_000):
            sets = PackedSets(table.column("set"))
            key, rep, part, left = (table.column(c).to_numpy() for c in ("key", "rep", "part", "left"))
            apart = table.column("apart").to_numpy(zero_copy_only=False).astype(bool)
            found = []

            def fits(x, y):
                ok = (part[x] != part[y]) & ((left[x] != left[y]) | ~apart[x])
                low, high = np.minimum(sets.size[x], sets.size[y]), np.maximum(sets.size[x], sets.size[y])
                return ok & (denominator * low >= numerator * high)

            def note(x, y, shared):
                ok = denominator * shared >= numerator * (sets.size[x] + sets.size[y] - shared)
                x, y = x[ok], y[ok]
                parts = np.stack([np.minimum(part[x], part[y]), np.maximum(part[x], part[y])], 1)
                once = np.unique(parts, axis=0, return_index=True)[1] if len(x) else []
                found.append(np.stack([rep[x][once], rep[y][once]], 1))

            for start, n in zip(*w.runs(key)):
                rows = np.arange(start, start + n)
                if n <= 24:
                    x, y = np.triu_indices(n, 1)
                    x, y = rows[x], rows[y]
                    ok = fits(x, y)
                    note(x[ok], y[ok], sets.shared(x[ok], y[ok]))
                    continue
                rows = rows[np.argsort(part[rows], kind="stable")]
                blocks = np.array_split(rows, -(-n // 512))
                for i, one in enumerate(blocks):
                    for two in blocks[i:]:
                        if part[one[0]] == part[two[-1]]:
                            continue
                        x, y = (z.ravel() for z in np.meshgrid(np.arange(len(one)), np.arange(len(two)), indexing="ij"))
                        ok = fits(one[x], two[y])
                        if one is two:
                            ok &= x < y
                        if ok.any():
                            x, y = x[ok], y[ok]
                            note(one[x], two[y], sets.products(one, two)[x, y])
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs.min(axis=1, initial=2**63 - 1)), pa.array(pairs.max(axis=1, initial=-(2**63)))],
                names=["a", "b"],
            )

    return run


def _within_buckets(buckets: DataFrame, signed: DataFrame, docs: DataFrame, settings: MinHash) -> DataFrame:
    """Links that tie together all that any chain of similar pairs within buckets ties together.

    ``buckets`` has (key, rep, size). First all members of a bucket are compared with one pivot.
    Members of one component need no further link, so of the buckets that still hold several
    components only members of different ones are compared, inside the bucket and on the full sets.
    """
    pivots = buckets.groupBy("key").agg(F.min(F.struct("rep", "size")).alias("p"))
    tied = buckets.join(pivots, "key").where("rep <> p.rep")
    alike = settings.denominator * F.least("size", "p.size") >= settings.numerator * F.greatest("size", "p.size")
    pairs = tied.where(alike).select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = _linked(pairs, signed, docs, settings)
    parts = components(links, "a", "b")
    known = buckets.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("part")
    )
    several = known.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key")
    mixed = written(known.join(several, "key", "left_semi"), "mixed")
    concerned = written(mixed.select(F.col("rep").alias("id")).distinct(), "concerned")
    sets = written(
        sized_join(docs, concerned, ["id"], "left_semi").mapInArrow(tidy(_sets(settings.shingle)), "rep long, set binary"),
        "sets",
    )
    more = written(
        split_crowds(mixed, settings.block_rows, "rep")
        .join(sets, "rep")
        .repartition(partitions(docs.sparkSession), "key")
        .sortWithinPartitions("key")
        .mapInArrow(tidy(_tying(settings)), "a long, b long")
        .distinct(),
        "links",
    )
    drop(docs.sparkSession, mixed, concerned, sets)
    return links.unionAll(more)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", settings: MinHash = MinHash()
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked if their shingle sets have a similarity of at least
    ``numerator / denominator``; ``component_id`` is the smallest id that a chain of links reaches and
    ``kept`` marks that document. A text that is null, empty or without words has no shingle and is
    linked with nothing. Rows that share an id are documents of their own, each with a row; of those that could
    be kept, the first by text is. Rows with a null id are left out. Other columns are not
    looked at. An empty table gives no rows.
    """
    return _told_apart(docs, id_column, text_column, settings)[0].drop(TURN)


TURN = "_turn"


def _told_apart(docs: DataFrame, id_column: str, text_column: str, settings: MinHash) -> tuple[DataFrame, bool]:
    """The result with ``_turn``, the row's number among those of its id; and whether any id is shared."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where(
        "id is not null"
    )
    texts, shared = numbered(texts, "id", "text", F.lit(1), TURN)
    if not shared:
        found = _classed(texts, settings)
        kept = (F.col("id") == F.col("component_id")).alias("kept")
        return found.select(F.col("id").alias(id_column), "n_shingles", "component_id", kept, F.lit(0).cast("long").alias(TURN)), False
    # All but the first row of an id stand under numbers that are no ids.
    low, high = texts.agg(F.min("id"), F.max("id")).first()
    number = F.monotonically_increasing_id()
    unused = F.lit(high) + 1 + number if high < 1 << 61 else F.lit(low) - 1 - number
    more = written(texts.where(F.col(TURN) > 0).select("id", TURN).repartition("id", TURN).withColumn("other", unused), "more")
    renamed = texts.join(more, ["id", TURN], "left").select(F.coalesce("other", "id").alias("id"), "text")
    found = _classed(written(renamed, "texts"), settings).withColumnRenamed("component_id", "part")
    back = more.select(F.col("other").alias("id"), F.col("id").alias("true_id"), TURN)
    found = found.join(back, "id", "left").withColumn("true_id", F.coalesce("true_id", "id"))
    found = written(found.withColumn(TURN, F.coalesce(TURN, F.lit(0).cast("long"))), "found")
    tops = written(
        found.groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct("true_id", TURN, "id")).alias("top")), "tops"
    )
    hot = hot_keys(tops, ["part"], "n")
    out = even_join(found, tops.select("part", "top"), ["part"], hot, ["id"])
    return out.select(
        F.col("true_id").alias(id_column), "n_shingles", F.col("top.true_id").alias("component_id"),
        (F.col("id") == F.col("top.id")).alias("kept"), TURN,
    ), True


def _classed(texts: DataFrame, settings: MinHash) -> DataFrame:
    """(id, n_shingles, component_id) of texts with ids of their own."""
    signed = written(texts.mapInArrow(tidy(_signed(settings)), SIGNED), "signatures")
    shingled = signed.where("n_shingles > 0")
    same = ["digest_a", "digest_b", "n_shingles"]
    classes = written(shingled.groupBy(*same).agg(F.min("id").alias("rep")), "classes")
    reps = written(
        shingled.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select(
            F.explode("keys").alias("key"), F.col("id").alias("rep"), F.col("n_shingles").alias("size")
        ),
        "bands",
    )
    shared = reps.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("key")
    buckets = written(reps.join(shared, "key", "left_semi"), "buckets")
    links = _within_buckets(buckets, signed, texts, settings)
    parts = components(links, "a", "b")
    named = classes.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select(
        *same, F.coalesce("component", "rep").alias("component_id")
    )
    found = shingled.select("id", *same).join(named, same).select("id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return found.unionAll(alone)


def keep_first(docs: DataFrame, settings: MinHash = MinHash()) -> DataFrame:
    """The documents without all but the first of each group of near duplicates; columns stay.

    Documents without an id are not compared and stay. Only the ids that go are joined.
    """
    found, shared = _told_apart(docs, "doc_id", "text", settings)
    gone = written(found.where("not kept").select(F.col("doc_id").alias("_gone"), F.col(TURN).alias("_gone_turn")), "gone")
    small = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = docs["doc_id"].cast("long") == small["_gone"]
    if not shared:
        return docs.join(small, same, "left_anti")
    told, _ = numbered(docs, "doc_id", "text", F.lit(1), TURN)
    same = (told["doc_id"].cast("long") == small["_gone"]) & (told[TURN] == small["_gone_turn"])
    return told.join(small, same, "left_anti").select(*docs.columns)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, settings=MinHash(shingle=2))


QUERIES = {"op10_minhash_near_dedup": (op10_minhash_near_dedup, None)}

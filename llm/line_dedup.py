"""Near-duplicate lines: an exact set-similarity join of the lines' word sets.

A line is the text between line feeds, its set the distinct words; lines without words take no part.
Two lines match if their sets have a Jaccard similarity of at least ``numerator / denominator``, and
of every matching pair the later line (by document id, then line number) goes.

1. Survey: one pass gives each line the digest of its word sequence and counts words in a sketch of
   ``CELLS`` counters (its size is fixed, whatever the corpus). Equal sequences form a class,
   known by its first line; only classes go on.
2. Index: a word's rarity is its counter, ties go by hash. A class is filed under each word of its
   prefix, in that order. Words of more than ``hot_count`` occurrences are filed together with the
   next common word instead: a matching pair shares at least two, so nothing is lost, and one
   frequent word gathers no crowd.
3. Filter: within a key, sorted by size, the length and positional filters and parity bitmaps leave
   few rows that have any partner.
4. Verify: only those classes' sets are made again from the text. Their heads show under which keys a
   pair's first shared word lies; there, and nowhere else, the full sets are compared. What leaves a key is a number of links and the
   earliest partner per class, never a list of pairs. Crowded keys are split into block pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import words as w
from llm.rows import numbered
from llm.sets import PackedSets, split_crowds, whole_keys
from llm.store import BROADCAST_ELEMENTS, drop, partitions, sized_join, written
from llm.tasks import tidy

CELL_BITS = 20
CELLS = 1 << CELL_BITS
BLOCKS = 64
LEVEL_BITS = 6
KEY_BITS = 40  # of a word that rows are brought together by; that the words agree is seen to later
WIDE = 77  # words beyond which a line has four 64-bit bitmaps


@dataclass(frozen=True)
class LineDedup:
    """Settings; the similarity must be above one half."""

    numerator: int = 4
    denominator: int = 5
    hot_count: int = 100_000
    block_rows: int = 2048

    def __post_init__(self):
        if not 1 < 2 * self.numerator / self.denominator <= 2:
            raise ValueError("the similarity must be above 0.5 and at most 1")


class _Lines:
    """The lines with words of a batch of texts."""

    def __init__(self, column):
        text = w.Words(column)
        feeds = np.flatnonzero(text.raw == w.NEWLINE)
        before = np.searchsorted(feeds, text.starts)
        self.starts, self.counts = w.runs(before + text.text)
        self.text = text.text[self.starts]
        self.number = before[self.starts] - np.searchsorted(feeds, text.offsets[self.text])
        self.hashes = text.hashes
        place = np.arange(len(text.hashes)) - np.repeat(self.starts, self.counts)
        place = w.mix(place.astype(np.uint64) + np.uint64(1))
        if len(self.starts):
            self.a = np.add.reduceat(w.mix(text.hashes ^ place), self.starts).view(np.int64)
            self.b = np.add.reduceat(w.mix(text.hashes + place), self.starts).view(np.int64)
        else:
            self.a = self.b = np.zeros(0, np.int64)

    def sets(self, chosen: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, token): the distinct words of the chosen lines from rare to frequent, as rarity over hash."""
        picked = np.repeat(chosen, self.counts)
        owner = np.repeat(np.cumsum(chosen) - 1, self.counts)[picked]
        h = self.hashes[picked]
        level = levels[h >> np.uint64(64 - CELL_BITS)].astype(np.uint64)
        return w.distinct_in_groups(owner, (level << np.uint64(64 - LEVEL_BITS)) | (h >> np.uint64(LEVEL_BITS)))


SURVEYED = "id long, line int, a long, b long, block int, counts binary"


def _surveyed(batches):
    schema = pa.schema(
        [
            ("id", pa.int64()),
            ("line", pa.int32()),
            ("a", pa.int64()),
            ("b", pa.int64()),
            ("block", pa.int32()),
            ("counts", pa.binary()),
        ]
    )
    counts, waiting, n = np.zeros(CELLS, np.int64), [], 0
    for batch in batches:
        for piece in w.pieces(batch, "text"):
            lines = _Lines(piece.column("text"))
            waiting.append((lines.hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64))
            n += len(lines.hashes)
            if n > 2 * CELLS:
                counts += np.bincount(np.concatenate(waiting), minlength=CELLS)
                waiting, n = [], 0
            rows = len(lines.starts)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id").take(pa.array(lines.text)),
                    pa.array((lines.number + piece.column("first").to_numpy()[lines.text]).astype(np.int32)),
                    pa.array(lines.a),
                    pa.array(lines.b),
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.binary()),
                ],
                schema=schema,
            )
    if waiting:
        counts += np.bincount(np.concatenate(waiting), minlength=CELLS)
    parts = [(k, part) for k, part in enumerate(counts.reshape(BLOCKS, -1)) if part.any()]
    none = pa.nulls(len(parts), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [
            none,
            pa.nulls(len(parts), pa.int32()),
            none,
            none,
            pa.array([k for k, _ in parts], pa.int32()),
            pa.array([part.tobytes() for _, part in parts], pa.binary()),
        ],
        schema=schema,
    )


def _added(batches):
    """Sums the counters of each block; keeps one array a block."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            total[block] = total.get(block, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
        names=["block", "counts"],
    )


def _levels(survey: DataFrame) -> np.ndarray:
    """The rarity level of each cell: a step for each doubling; ``CELLS`` bytes at any corpus size."""
    rows = (
        survey.where("block is not null")
        .select("block", "counts")
        .repartition(BLOCKS, "block")
        .mapInArrow(tidy(_added), "block int, counts binary")
        .collect()
    )
    counts = np.zeros((BLOCKS, CELLS // BLOCKS), np.int64)
    for row in rows:
        counts[row["block"]] += np.frombuffer(row["counts"], np.int64)
    return np.ceil(np.log2(np.maximum(counts.ravel(), 1))).astype(np.uint8)


def _least_overlap(settings: LineDedup, size: np.ndarray) -> np.ndarray:
    """Words that a line of this size shares with any match: ceil(t * size)."""
    return -(-settings.numerator * size // settings.denominator)


def _needed(settings: LineDedup, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Words that lines of these sizes must share: ceil(t / (1 + t) * (one + two))."""
    return -(-settings.numerator * (one + two) // (settings.numerator + settings.denominator))


BITS = ["bits", "bits_1", "bits_2", "bits_3"]
INDEXED = "key long, depth int, a long, size int, place int, bits long, bits_1 long, bits_2 long, bits_3 long"


def _indexed(settings: LineDedup, levels):
    hot = int(np.ceil(np.log2(settings.hot_count)))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for piece in w.pieces(batch, "text"):
                lines = _Lines(piece.column("text"))
                fresh = np.zeros(len(lines.a), bool)
                for i, a in enumerate(lines.a.tolist()):
                    if a not in seen:
                        seen.add(a)
                        fresh[i] = True
                owner, token = lines.sets(fresh, levels.value)
                starts, size = w.runs(owner)
                if not len(starts):
                    continue
                spot = w.mix(token)
                bit = np.uint64(1) << (spot >> np.uint64(58))
                bits = [np.bitwise_xor.reduceat(bit, starts)]
                quarter = np.where(np.repeat(size > WIDE, size), spot & np.uint64(3), np.uint64(0))
                for k in (1, 2, 3):
                    bits.append(np.bitwise_xor.reduceat(np.where(quarter == k, bit, np.uint64(0)), starts))
                place = np.arange(len(token)) - np.repeat(starts, size)
                each = np.repeat(size, size)
                in_prefix = place <= each - _least_overlap(settings, each)
                is_hot = (token >> np.uint64(64 - LEVEL_BITS) > hot) & (each > 1)
                first = np.flatnonzero(in_prefix & ~is_hot)
                keys, at, where = [token[first]], [owner[first]], [place[first]]
                single = len(first)
                crowd = np.flatnonzero(in_prefix & is_hot)
                step = 1
                while len(crowd):
                    second = crowd + step
                    reach = place[crowd] + step
                    fits = (reach < each[crowd]) & (reach <= each[crowd] - _least_overlap(settings, each[crowd]) + 1)
                    crowd, second = crowd[fits], second[fits]
                    keys.append(w.mix(token[crowd] * np.uint64(3) + token[second]))
                    at.append(owner[crowd])
                    where.append(place[second])
                    step += 1
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((np.concatenate(keys) >> np.uint64(64 - KEY_BITS)).view(np.int64)),
                        pa.array((1 + (np.arange(len(at)) >= single)).astype(np.int32)),
                        pa.array(lines.a[fresh][at]),
                        pa.array(size[at].astype(np.int32)),
                        pa.array(np.concatenate(where).astype(np.int32)),
                        *(pa.array(x[at].view(np.int64)) for x in bits),
                    ],
                    names=["key", "depth", "a", "size", "place", *BITS],
                )

    return run


def _near(settings: LineDedup, key, size, place, depth, bits, one, step):
    """The rows that still have a neighbour at this distance under their key within the length filter
    (rows are sorted by key and size), and the pairs that also pass the positional filter and the bitmaps."""
    two = one + step
    near = (key[one] == key[two]) & (settings.numerator * size[two] <= settings.denominator * size[one])
    open_ = one[near]
    return open_, *_filtered(settings, size, place, depth, bits, open_, open_ + step)


def _filtered(settings: LineDedup, size, place, depth, bits, one, two):
    need = _needed(settings, size[one], size[two])
    fits = depth[one] + np.minimum(size[one] - place[one], size[two] - place[two]) - 1 >= need
    one, two, need = one[fits], two[fits], need[fits]
    most = size[one] + size[two] - 2 * need
    folded = bits[0][one] ^ bits[0][two]
    fits = np.bitwise_count(folded) <= most
    wide = np.flatnonzero(fits & (size[one] > WIDE) & (size[two] > WIDE))
    parts = [x[one[wide]] ^ x[two[wide]] for x in bits[1:]]
    parts.append(folded[wide] ^ parts[0] ^ parts[1] ^ parts[2])
    fits[wide] = sum(np.bitwise_count(x).astype(np.int64) for x in parts) <= most[wide]
    return one[fits], two[fits]


def _numbers(table: pa.Table, *columns: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64) for c in columns]


def _with_partner(settings: LineDedup):
    """Rows that pass all filters with some row of another class under their key."""

    def run(batches):
        for table in whole_keys(batches, 200_000):
            key, a, size, place, depth = _numbers(table, "key", "a", "size", "place", "depth")
            bits = [x.view(np.uint64) for x in _numbers(table, *BITS)]
            marked = np.zeros(len(key), bool)
            one, step = np.arange(len(key) - 1), 1
            while len(one):
                one, x, y = _near(settings, key, size, place, depth, bits, one, step)
                fits = a[x] != a[y]
                marked[x[fits]] = marked[y[fits]] = True
                step += 1
                one = one[one + step < len(key)]
            yield from table.filter(pa.array(marked)).to_batches()

    return run


SETS = "a long, b long, id long, line int, tokens binary"


def _line_sets(levels):
    """(a, b, id, line, tokens) of the lines whose numbers are in ``lines``."""

    def run(batches):
        for batch in batches:
            for piece in w.pieces(batch, "text"):
                lines = _Lines(piece.column("text"))
                wanted = piece.column("lines")
                counts = wanted.value_lengths().to_numpy()
                pair = np.repeat(np.arange(len(counts)), counts) << 32 | wanted.flatten().to_numpy()
                number = lines.number + piece.column("first").to_numpy()[lines.text]
                chosen = np.isin(lines.text << 32 | number, pair)
                owner, token = lines.sets(chosen, levels.value)
                n = int(chosen.sum())
                ends = 8 * np.searchsorted(owner, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(lines.a[chosen]),
                        pa.array(lines.b[chosen]),
                        piece.column("id").take(pa.array(lines.text[chosen])),
                        pa.array(number[chosen].astype(np.int32)),
                        pa.Array.from_buffers(
                            pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(token.tobytes())]
                        ).cast(pa.binary()),
                    ],
                    names=["a", "b", "id", "line", "tokens"],
                )

    return run


SMALL = 48


class _Crowd(PackedSets):
    """Rows under some keys with their token sets or the heads of them."""

    def __init__(self, table: pa.Table):
        super().__init__(table.column("tokens"))
        self.key, self.a, self.b, self.place, self.depth, self.left = _numbers(
            table, "key", "a", "b", "place", "depth", "left"
        )
        self.apart = table.column("apart").to_numpy(zero_copy_only=False).astype(bool)

    def distinct(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether a pair is of two classes and to be compared in this group."""
        other = (self.a[x] != self.a[y]) | (self.b[x] != self.b[y])
        return other & ((self.left[x] != self.left[y]) | ~self.apart[x])

    def head(self, row: int, n: int) -> np.ndarray:
        return self.element[self.start[row] : self.start[row] + n]

    def here(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the key is the first (at depth 2: the first two) of the words that the pair shares."""
        out = np.zeros(len(x), bool)
        px, py, before = self.place[x], self.place[y], self.depth[x] - 1
        wide = np.maximum(px, py)
        for low, high in ((-1, 4), (4, 12), (12, 32)):
            chosen = np.flatnonzero((wide > low) & (wide <= high))
            for part in np.array_split(chosen, max(1, len(chosen) * high * high // 20_000_000)):
                shared = np.zeros(len(part), np.int64)
                cols = np.arange(high)
                both = []
                for rows, places in ((x[part], px[part]), (y[part], py[part])):
                    at = np.minimum(self.start[rows][:, None] + cols, len(self.element) - 1)
                    both.append((self.element[at], cols < places[:, None]))
                for i in range(high):
                    same = (both[0][0][:, i, None] == both[1][0]) & both[1][1]
                    shared += (same.any(axis=1) & both[0][1][:, i]).astype(np.int64)
                out[part] = shared == before[part]
        for k in np.flatnonzero(wide > 32):
            shared = len(np.intersect1d(self.head(x[k], px[k]), self.head(y[k], py[k]), assume_unique=True))
            out[k] = shared == before[k]
        return out & (self.element[self.start[x] + px] == self.element[self.start[y] + py])


def _owning(settings: LineDedup):
    """Rows whose key is the place where some pair is to be verified: its first shared word(s)."""

    def run(batches):
        for table in whole_keys(batches, 50_000):
            crowd = _Crowd(table)
            size = _numbers(table, "size")[0]
            bits = [x.view(np.uint64) for x in _numbers(table, *BITS)]
            marked = np.zeros(len(size), bool)
            one, step = np.arange(len(size) - 1), 1
            while len(one):
                one, x, y = _near(settings, crowd.key, size, crowd.place, crowd.depth, bits, one, step)
                fits = crowd.distinct(x, y) & ~(marked[x] & marked[y])
                x, y = x[fits], y[fits]
                fits = crowd.here(x, y)
                marked[x[fits]] = marked[y[fits]] = True
                step += 1
                one = one[one + step < len(size)]
            columns = ["key", "depth", "a", "b", "place", "left", "apart"]
            yield from table.select(columns).filter(pa.array(marked)).to_batches()

    return run


def _verified(settings: LineDedup):
    """(a, b, n_links, id, line): links found under a key, and the earliest partner, of each row."""

    def run(batches):
        for table in whole_keys(batches, 20_000):
            crowd = _Crowd(table)
            key, size = crowd.key, crowd.size
            ids, numbers = _numbers(table, "id", "line")
            order = np.lexsort((numbers, ids))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            links = np.zeros(len(key), np.int64)
            best = np.full(len(key), len(key), np.int64)

            def count(x, y):
                np.add.at(links, x, 1)
                np.add.at(links, y, 1)
                np.minimum.at(best, x, rank[y])
                np.minimum.at(best, y, rank[x])

            def owned(x, y):
                fits = crowd.distinct(x, y)
                x, y = x[fits], y[fits]
                fits = crowd.here(x, y)
                return x[fits], y[fits]

            starts, counts = w.runs(key)
            ends = np.repeat(starts + counts, counts)
            one, step = np.flatnonzero(np.repeat(counts <= SMALL, counts)), 1
            while len(one):
                one = one[one + step < ends[one]]
                x, y = one, one + step
                low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                fits = high * settings.numerator <= settings.denominator * low
                x, y = owned(x[fits], y[fits])
                fits = crowd.shared(x, y) >= _needed(settings, size[x], size[y])
                count(x[fits], y[fits])
                step += 1
            for start, n in zip(starts[counts > SMALL], counts[counts > SMALL]):
                blocks = np.array_split(np.arange(start, start + n), -(-n // 512))
                for i, first in enumerate(blocks):
                    for second in blocks[i:]:
                        need = _needed(settings, size[first][:, None], size[second][None, :])
                        enough = crowd.products(first, second) >= need
                        x, y = np.nonzero(np.triu(enough, 1) if first is second else enough)
                        count(*owned(first[x], second[y]))
            found = np.flatnonzero(links)
            partner = order[best[found]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(crowd.a[found]),
                    pa.array(crowd.b[found]),
                    pa.array(links[found]),
                    pa.array(ids[partner]),
                    pa.array(numbers[partner].astype(np.int32)),
                ],
                names=["a", "b", "n_links", "id", "line"],
            )

    return run


def _links(texts: DataFrame, survey: DataFrame, classes: DataFrame, settings: LineDedup) -> DataFrame:
    """(a, b, n_links, partner): for each class with a match, the number of matching classes and the earliest."""
    spark = texts.sparkSession
    levels = spark.sparkContext.broadcast(_levels(survey))
    index = texts.mapInArrow(tidy(_indexed(settings, levels)), INDEXED)
    many = partitions(spark)
    marked = written(
        index.repartition(many, "key").sortWithinPartitions("key", "size", "a").mapInArrow(tidy(_with_partner(settings)), INDEXED),
        "marked",
    )
    concerned = written(
        classes.join(marked.select("a").distinct(), "a").groupBy("id").agg(F.collect_list("line").alias("lines")),
        "concerned",
    )
    sets = written(sized_join(texts, concerned, ["id"], "inner").mapInArrow(tidy(_line_sets(levels)), SETS), "sets")
    heads = sets.join(marked.distinct(), "a").select(
        "key", "depth", "a", "b", "size", "place", *BITS, F.expr("substring(tokens, 1, 8 * (place + 1))").alias("tokens")
    )
    owners = written(
        split_crowds(heads, settings.block_rows, "a", "b", of=marked.distinct())
        .repartition(many, "key")
        .sortWithinPartitions("key", "size")
        .mapInArrow(tidy(_owning(settings)), "key long, depth int, a long, b long, place int, left long, apart boolean"),
        "owners",
    )
    found = (
        owners.join(sets, ["a", "b"])
        .repartition(many, "key")
        .sortWithinPartitions("key")
        .mapInArrow(tidy(_verified(settings)), "a long, b long, n_links long, id long, line int")
    )
    links = written(
        found.groupBy("a", "b").agg(
            F.sum("n_links").alias("n_links"), F.min(F.struct("id", "line")).alias("partner")
        ),
        "links",
    )
    levels.destroy()
    drop(spark, marked, concerned, sets, owners)
    return links


LINES = "array<struct<line:int,class_id:bigint,class_line:int,n_links:bigint,removed:boolean>>"


def matched_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", settings: LineDedup = LineDedup()
) -> DataFrame:
    """(id, lines): the lines of each document that match another line, with their class and links.

    A class holds the lines of one word sequence (A-Z in lower case) and is named by its first line;
    ``n_links`` counts the other classes that match it; ``removed`` marks a line with an earlier
    match. Documents without such a line have no row. Rows that share an id are numbered as one document,
    in order of text, so the lines of the second go on where those of the first end. Rows with a null id or
    text have no lines. An empty table gives no rows.
    """
    return _matched(numbered(docs, id_column, text_column, _line_count(text_column), FIRST)[0], id_column, text_column, settings)


FIRST = "_first_line"


def _line_count(text_column: str):
    return F.coalesce(F.size(F.split(F.col(text_column).cast("string"), "\n", -1)), F.lit(0))


def _matched(docs: DataFrame, id_column: str, text_column: str, settings: LineDedup) -> DataFrame:
    texts = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).cast("string").alias("text"),
        F.col(FIRST).alias("first"),
    ).where("id is not null and text is not null")
    survey = written(texts.mapInArrow(tidy(_surveyed), SURVEYED), "survey")
    lines = survey.where("block is null").select("id", "line", "a", "b")
    classes = written(
        lines.groupBy("a", "b")
        .agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("copies"))
        .select("a", "b", "first.id", "first.line", "copies"),
        "classes",
    )
    links = _links(texts, survey, classes, settings)
    shared = written(
        classes.join(links.withColumnRenamed("id", "i"), ["a", "b"], "left")
        .where("copies > 1 or n_links is not null")
        .select(
            "a",
            "b",
            F.col("id").alias("class_id"),
            F.col("line").alias("class_line"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.least(F.struct("id", "line"), F.coalesce("partner", F.struct("id", "line"))).alias("earliest"),
        ),
        "shared",
    )
    found = written(
        lines.join(shared, ["a", "b"]).select(
            "id",
            F.struct(
                "line",
                "class_id",
                "class_line",
                "n_links",
                (F.struct("id", "line") != F.col("earliest")).alias("removed"),
            ).alias("found"),
        )
        .groupBy("id")
        .agg(F.array_sort(F.collect_list("found")).alias("lines"))
        .select(F.col("id").alias(id_column), F.col("lines").cast(LINES)),
        "matched",
    )
    drop(docs.sparkSession, survey, classes, links, shared)
    return found


def _without(text_at: int, gone_at: int):
    """Cuts the numbered lines out of each text."""

    def run(batches):
        for batch in (piece for x in batches for piece in w.pieces(x, x.schema.names[text_at], 1 << 20)):
            texts, gone = batch.column(text_at), batch.column(gone_at)
            out = texts
            if gone.null_count < len(gone):
                kept = texts.to_pylist()
                for k, numbers in enumerate(gone.to_pylist()):
                    if numbers and kept[k] is not None:
                        numbers = set(numbers)
                        kept[k] = "\n".join(x for i, x in enumerate(kept[k].split("\n")) if i not in numbers)
                out = pa.array(kept, texts.type)
            yield batch.set_column(text_at, batch.schema.field(text_at), out)

    return run


def dedup_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", settings: LineDedup = LineDedup()
) -> DataFrame:
    """The documents without the lines that match an earlier line, with the column ``matched_lines``.

    Every document stays, in any case with its other columns (a column of that name is replaced); a
    document whose lines all go keeps the empty text. Null texts stay null. Rows that share an id are documents of
    their own: the later of equal ones loses its lines, others only lines that an earlier one has, too.
    """
    columns = [*[c for c in docs.columns if c != "matched_lines"], "matched_lines"]
    docs, shared = numbered(docs.drop("matched_lines"), id_column, text_column, _line_count(text_column), FIRST)
    found = _matched(docs, id_column, text_column, settings).select(
        F.col(id_column).alias("_line_dedup_id"), F.col("lines").alias("matched_lines")
    )
    key = docs[id_column].cast("long") == found["_line_dedup_id"]
    few = found.agg(F.sum(F.size("matched_lines"))).first()[0] or 0
    joined = docs.join(F.broadcast(found) if few <= BROADCAST_ELEMENTS else found, key, "left")
    if shared:
        here = F.col("matched_lines")
        own = F.filter(here, lambda x: (x["line"] >= F.col(FIRST)) & (x["line"] < F.col(FIRST) + _line_count(text_column)))
        own = F.transform(own, lambda x: x.withField("line", (x["line"] - F.col(FIRST)).cast("int")))
        joined = joined.withColumn("matched_lines", F.when(F.size(own) > 0, own))
    joined = joined.select(
        *columns,
        F.transform(F.filter("matched_lines", lambda x: x["removed"]), lambda x: x["line"]).alias("_gone"),
    )
    edited = joined.mapInArrow(tidy(_without(columns.index(text_column), len(columns))), joined.schema)
    return edited.select(*columns)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines; ``n_chars`` follows the text.

    A document that has lost lines and has no word left goes: all it said is said by earlier ones.
    """
    columns = docs.columns
    out = dedup_lines(docs)
    lost = F.exists(F.coalesce("matched_lines", F.array().cast(LINES)), lambda x: x["removed"])
    out = out.where(~(lost & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    lines = F.coalesce("matched_lines", F.array().cast(LINES))
    return out.select(
        "doc_id",
        "text",
        F.size(F.filter(lines, lambda x: x["removed"])).cast("long").alias("n_removed"),
        F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + x["n_links"]).alias("n_links"),
        lines.alias("matched_lines"),
    )


QUERIES = {"op1_line_dedup": (op1_line_dedup, None)}

"""Log-probabilities of texts by prediction by partial matching over bytes.

The coded form of a text is its lower-case words, each followed by a blank, and one end byte. Contexts
are the ``order`` bytes before; a text begins in a context of end bytes. The trie holds how often each
byte follows each context of 0 to ``order`` bytes in the training texts. A byte is coded in the longest
context of the trie by its count; if it is new there, an escape leads to the context one shorter, and
so on down to all 256 bytes. With s different bytes seen t times, a byte seen n times has n / (t + s)
and the escape s / (t + s) (method C); bytes that a longer context has seen are excluded from the counts
of the shorter ones, as the escape has ruled them out.

Counts cover all training texts, and none is left out: the trie is one table of grams and one of contexts
a level. The workers get the costs of the ``1 / least_share`` most frequent grams at most, whatever the
corpus; the other grams of the texts are joined with the tables, each distinct gram once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import words as w
from llm.store import BROADCAST_ROWS, drop, written

BLANK, END = 0x20, 0x0A


@dataclass(frozen=True)
class Ppm:
    """Settings. Words of at least ``head_share`` of the training tokens are looked up in the worker, as are
    the most frequent grams, ``1 / least_share`` at most. Neither changes a score."""

    order: int = 5
    least_share: float = 2.0**-22
    head_share: float = 2.0**-20

    def __post_init__(self):
        if not 0 <= self.order <= 6:
            raise ValueError("the order must be 0 to 6")


def coded(text: w.Words) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of all texts and where each one's begin (and the last one's end)."""
    size = text.ends - text.starts + 1
    before = np.cumsum(size) - size
    n_texts = len(text.first)
    end_of_words = np.r_[0, np.cumsum(size)][text.first + text.count]
    ends = end_of_words + np.arange(1, n_texts + 1)
    out = np.full(int(size.sum()) + n_texts, BLANK, np.uint8)
    lengths = size - 1
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    target = place + np.repeat(before + text.text, lengths)
    out[target] = w.lower(text.raw)[place + np.repeat(text.starts, lengths)]
    out[ends - 1] = END
    return out, np.r_[0, ends]


def grams(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, the latest lowest; texts begin after end bytes.

    As every text ends in an end byte, only older bytes of the text before have to be covered.
    """
    value = np.zeros(len(data), np.uint64)
    for i in range(order, -1, -1):
        value <<= np.uint64(8)
        if i < len(data):
            value[i:] |= data[: len(data) - i]
        value[:i] |= np.uint64(END)
    for i in range(1, order):
        # i bytes into a text the context reaches back over its start; bytes further back are end bytes
        at = starts[:-1] + i
        at = at[at < starts[1:]]
        keep = (1 << (8 * (i + 1))) - 1
        ends = sum(END << (8 * k) for k in range(i + 1, order + 1))
        value[at] = (value[at] & np.uint64(keep)) | np.uint64(ends)
    if order:
        first = starts[:-1]
        value[first] = (value[first] & np.uint64(0xFF)) | np.uint64(sum(END << (8 * k) for k in range(1, order + 1)))
    return value


class _Counter:
    """Counts of 64-bit values; gives them up when there are many."""

    def __init__(self, limit: int = 2_000_000):
        self.limit, self.values, self.counts, self.waiting, self.n = limit, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.n += len(values)
        if self.n > self.limit:
            self._settle()

    def _settle(self) -> None:
        if self.waiting:
            values, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
            both = np.concatenate([self.values, values])
            self.values, at = np.unique(both, return_inverse=True)
            self.counts = np.bincount(at, np.r_[self.counts, counts], len(self.values)).astype(np.int64)
            self.waiting, self.n = [], 0

    def full(self) -> bool:
        return len(self.values) > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        out = self.values, self.counts
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return out


GRAM, WORD, TEXTS = 0, 1, 2
COUNTED = "kind int, value long, n long"


def _gathered(order: int):
    """Counts of grams and words of the training texts, and of the texts; partly summed in the task."""

    def rows(kind, values, counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(values), kind, np.int32)), pa.array(values.view(np.int64)), pa.array(counts)],
            names=["kind", "value", "n"],
        )

    def run(batches):
        counters = {GRAM: _Counter(), WORD: _Counter()}
        texts = 0
        for batch in batches:
            for piece in w.pieces(batch, "text"):
                text = w.Words(piece.column("text"))
                texts += len(text.first)
                counters[GRAM].add(grams(*coded(text), order))
                counters[WORD].add(text.hashes)
                for kind, counter in counters.items():
                    if counter.full():
                        yield rows(kind, *counter.take())
        for kind, counter in counters.items():
            yield rows(kind, *counter.take())
        yield rows(TEXTS, np.zeros(1, np.uint64), np.array([texts], np.int64))

    return run


def _masked(k: int):
    """The last ``k`` bytes of a gram."""
    return F.col("value").bitwiseAND(F.lit((1 << (8 * k)) - 1))


class Trie:
    """Tables of the grams of k + 1 bytes (value, n) and of their contexts of k bytes, k = 0 to ``order``.

    A context has what coding in it and escaping from it cost (log10): ``top`` is that of t + s, ``escape`` the
    escape; ``rest`` is that of t + s in the next shorter context with this one's bytes excluded, ``step`` the
    escape from there. No context has more than 256 grams, and no gram follows on more than 256 bytes, so no
    key of the joins is hot.
    """

    def __init__(self, counts: DataFrame, order: int):
        self.order, self.grams = order, [counts]
        for k in range(order, 0, -1):
            self.grams.insert(0, written(self.grams[0].groupBy(_masked(k).alias("value")).agg(F.sum("n").alias("n")), "level"))
        self.t, self.s = self.grams[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.uniform = -float(np.log10(max(256 - self.s, 1)))
        self.contexts = [None]
        for k in range(1, order + 1):
            self.contexts.append(written(self._context_costs(k), "contexts"))

    def _context_costs(self, k: int) -> DataFrame:
        shorter = self.grams[k - 1].select(F.col("value").alias("suffix"), F.col("n").alias("n_suffix"))
        out = (
            self.grams[k]
            .withColumn("suffix", _masked(k))
            .join(shorter, "suffix")
            .groupBy(F.shiftright("value", 8).alias("context"))
            .agg(F.sum("n").alias("t"), F.count("*").alias("s"), F.sum("n_suffix").alias("excluded"))
        )
        if k == 1:
            out = out.select("*", F.lit(self.t).alias("t_parent"), F.lit(self.s).alias("s_parent"))
        else:
            parents = self.contexts[k - 1].select(
                F.col("context").alias("parent"), F.col("t").alias("t_parent"), F.col("s").alias("s_parent")
            )
            out = out.withColumn("parent", F.col("context").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))).join(parents, "parent")
        new = F.col("s_parent") - F.col("s")
        top = F.log10((F.col("t") + F.col("s")).cast("double"))
        rest = F.log10(F.greatest(F.col("t_parent") - F.col("excluded") + new, F.lit(1)).cast("double"))
        return out.select(
            "context",
            "t",
            "s",
            top.alias("top"),
            (F.log10(F.col("s").cast("double")) - top).alias("escape"),
            rest.alias("rest"),
            F.when(new > 0, F.log10(new.cast("double")) - rest).otherwise(0.0).alias("step"),
        )

    def _with_context(self, grams: DataFrame, k: int) -> DataFrame:
        if k:
            return grams.withColumn("context", F.shiftright("value", 8)).join(self.contexts[k], "context", "left")
        known = F.lit(self.t > 0)
        top = float(np.log10(self.t + self.s)) if self.t else 0.0
        escape = float(np.log10(self.s)) - top if self.t else 0.0
        return grams.select("*", F.when(known, F.lit(top)).alias("top"), F.when(known, F.lit(escape)).alias("escape"))

    def frequent(self, most: float) -> DataFrame:
        """(value, cost) of the most frequent grams of the highest level, at most ``most``."""
        grams = self.grams[self.order].withColumn("size", F.floor(F.log2(F.col("n").cast("double")) * 8))
        least, total = None, 0
        for size, n in sorted(grams.groupBy("size").count().collect(), reverse=True):
            total += n
            if total > most:
                break
            least = size
        grams = grams.where(F.col("size") >= least) if least is not None else grams.limit(0)
        return self._with_context(grams, self.order).select(
            "value", (F.log10(F.col("n").cast("double")) - F.col("top")).alias("cost")
        )

    def costs(self, asked: DataFrame) -> DataFrame:
        """(value, cost) of distinct grams: log10 of the probability of the last byte after those before it."""
        return self._answers(asked, self.order).select("value", F.col("start").alias("cost"))

    def _answers(self, asked: DataFrame, k: int) -> DataFrame:
        """(value, n, start, past): the count, and the cost in the longest known context of at most ``k`` bytes.

        ``past`` is the cost after the escape from the known context of ``k`` bytes, for grams without a count.
        """
        met = self._with_context(asked.join(self.grams[k], "value", "left"), k)
        n = F.log10(F.col("n").cast("double"))
        if not k:
            past = F.lit(self.uniform)
            start = F.when(F.col("n").isNotNull(), n - F.col("top")).otherwise(F.coalesce("escape", F.lit(0.0)) + past)
            return met.select("value", "n", start.alias("start"), past.alias("past"))
        met = written(met.withColumn("suffix", _masked(k)), "met")
        seen = met.where("n is not null").select("value", "n", (n - F.col("top")).alias("start"), F.lit(None).cast("double").alias("past"))
        missed = met.where("n is null").drop("n")
        below = self._answers(missed.select(F.col("suffix").alias("value")).distinct(), k - 1).select(
            F.col("value").alias("suffix"), "n", F.col("start").alias("start_below"), F.col("past").alias("past_below")
        )
        past = F.when(F.col("n").isNotNull(), n - F.col("rest")).otherwise(F.col("step") + F.col("past_below"))
        start = F.when(F.col("top").isNull(), F.col("start_below")).otherwise(F.col("escape") + past)
        return seen.union(
            missed.join(below, "suffix").select("value", F.lit(None).cast("long").alias("n"), start.alias("start"), past.alias("past"))
        )


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


class Cache:
    """A hash table of the costs of frequent grams, at most half full; a gram without a near slot is not in it."""

    EMPTY = np.iinfo(np.uint64).max
    STEPS = 16

    def __init__(self, grams: np.ndarray, costs: np.ndarray, order: int):
        self.order = order
        self.bits = max(4, (2 * len(grams)).bit_length())
        self.keys = np.full((1 << self.bits) + self.STEPS, self.EMPTY, np.uint64)
        self.costs = np.zeros(len(self.keys), np.float64)
        slot = self._slot(grams)
        left = np.arange(len(grams))
        for step in range(self.STEPS):
            at = slot[left] + step
            free = self.keys[at] == self.EMPTY
            self.keys[at[free]] = grams[left[free]]
            won = self.keys[at] == grams[left]
            self.costs[at[won]] = costs[left[won]]
            left = left[~won]

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cost of each gram, 0 where it is missing, and the places of the missing ones."""
        slot = self._slot(grams)
        key = self.keys[slot]
        out = self.costs[slot]
        lost = key != grams
        out[lost] = 0.0
        missing = [np.flatnonzero(lost & (key == self.EMPTY))]
        left = np.flatnonzero(lost & (key != self.EMPTY))
        for step in range(1, self.STEPS):
            at = slot[left] + step
            key = self.keys[at]
            hit = key == grams[left]
            out[left[hit]] = self.costs[at[hit]]
            missing.append(left[key == self.EMPTY])
            left = left[~hit & (key != self.EMPTY)]
        return out, np.concatenate([*missing, left])


COUNTS = "array<struct<value:bigint,n:bigint>>"
SCORED = f"doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double, tail {COUNTS}, grams {COUNTS}"


def _scored(frequent, head):
    kind = pa.struct([("value", pa.int64()), ("n", pa.int64())])

    def lists(owner, value, n, size):
        rows = pa.StructArray.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(size + 1)).astype(np.int32)), rows)

    def run(batches):
        cache, (known, logs) = frequent.value, head.value
        for batch in batches:
            for piece in w.pieces(batch, "text"):
                text = w.Words(piece.column("text"))
                size = len(text.first)
                data, starts = coded(text)
                gram = grams(data, starts, cache.order)
                cost, missing = cache.look(gram)
                score = np.add.reduceat(cost, starts[:-1]) if len(starts) > 1 else np.zeros(0)
                rare = _counted(np.searchsorted(starts, missing, "right") - 1, gram[missing])
                owner, word, n = _counted(text.text, text.hashes)
                at, has = _find(known, word)
                log_sum = np.bincount(owner[has], n[has] * logs[at[has]], size).astype(np.float64)
                n_known = np.bincount(owner[has], n[has], size).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        piece.column("held_out"),
                        pa.array(text.count + 1),
                        pa.array(n_known),
                        pa.array(log_sum),
                        pa.array(score),
                        lists(owner[~has], word[~has], n[~has], size),
                        lists(*rare, size),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "log_sum", "score", "tail", "grams"],
                )

    return run


def _counted(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, value, count) of the distinct values of each text."""
    order = w.sort_in_groups(text, value) if len(value) else np.zeros(0, np.int64)
    owner, value = text[order], value[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]) if len(order) else order
    return owner[new], value[new], np.diff(np.r_[new, len(order)])


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The values and the other column, ascending by the unsigned value."""
    table = df.toArrow()
    value, other = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(value)
    return value[order], other[order]


def train(texts: DataFrame, settings: Ppm = Ppm()) -> tuple[Trie, DataFrame, int]:
    """The trie, the table (value, n) of word counts by hash, and the number of texts, from column ``text``."""
    gathered = written(
        texts.mapInArrow(_gathered(settings.order), COUNTED).groupBy("kind", "value").agg(F.sum("n").alias("n")), "gathered"
    )
    n_texts = gathered.where(F.col("kind") == TEXTS).agg(F.sum("n")).first()[0] or 0
    trie = Trie(gathered.where(F.col("kind") == GRAM).select("value", "n"), settings.order)
    return trie, gathered.where(F.col("kind") == WORD).select("value", "n"), n_texts


#: Grams asked for by at least this share of all (row, gram) pairs are joined by broadcast, so that no key is hot.
HOT_SHARE = 2.0**-18


def _gram_scores(rows: DataFrame, trie: Trie) -> DataFrame:
    """(row, more_score): what the grams cost that were not looked up in the worker, from (row, grams)."""
    pairs = rows.select("row", F.explode("grams").alias("g")).select("row", F.col("g.value").alias("value"), F.col("g.n").alias("times"))
    asked = written(pairs.groupBy("value").agg(F.count("*").alias("pairs")), "asked")
    size = asked.agg(F.count("*"), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    costs = written(trie.costs(asked.select("value")), "costs")
    if size[0] <= BROADCAST_ROWS:
        priced = pairs.join(F.broadcast(costs), "value")
    else:
        hot = costs.join(asked.where(F.col("pairs") >= HOT_SHARE * size[1]).select("value"), "value", "left_semi")
        tried = pairs.join(F.broadcast(hot), "value", "left")
        rest = tried.where("cost is null").drop("cost").join(costs, "value")
        priced = tried.where("cost is not null").unionByName(rest)
    return priced.groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("more_score"))


def score_texts(docs: DataFrame, settings: Ppm = Ppm()) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs`` has doc_id, text and held_out; the texts with held_out false are learned from. ``base_score``
    is that of single words, add-one smoothed, with the end as a word. Null and empty texts are just an
    end. Without training texts every byte has 1/256. Rows that share an id are scored each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("held_out").cast("boolean"))
    trie, words, ends = train(texts.where("not held_out").select("text"), settings)
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_tokens, n_kinds = size[0] + ends, size[1] + (1 if ends else 0)
    frequent = Cache(*_arrays(trie.frequent(1 / settings.least_share)), settings.order)
    head = _arrays(words.where(F.col("n") >= max(2, settings.head_share * n_tokens)))
    context = spark.sparkContext
    head = context.broadcast((head[0], np.log10(head[1] + 1.0)))
    rows = written(
        texts.mapInArrow(_scored(context.broadcast(frequent), head), SCORED).withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    rare = rows.select("row", F.explode("tail").alias("t")).select("row", F.col("t.value").alias("value"), F.col("t.n").alias("times"))
    tail = (
        rare.join(words, "value")
        .groupBy("row")
        .agg(
            F.sum("times").alias("more_known"),
            F.sum(F.col("times") * F.log10(F.col("n").cast("double") + 1)).alias("more_log"),
        )
    )
    floor = float(np.log10(n_tokens + n_kinds + 1))
    end_log = float(np.log10(ends + 1))
    more = _gram_scores(rows, trie)
    drop(spark, *trie.grams[:-1], *trie.contexts[1:])
    return rows.drop("tail", "grams").join(tail, "row", "left").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("more_log", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(floor)).alias(
            "base_score"
        ),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op3_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bucket = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return score_texts(docs.select("doc_id", "text", (bucket == 2).alias("held_out")))


QUERIES = {"op3_ppm_scoring": (op3_ppm_scoring, None)}

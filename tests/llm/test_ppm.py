"""PPM scores against a plain implementation, and word scores against counting."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from llm.ppm import Ppm, score_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def coded(text):
    return b"".join(x.encode() + b" " for x in tokens(text)) + b"\n"


def brute(train, texts, order):
    counts = defaultdict(Counter)
    for text in train:
        data = b"\n" * order + coded(text)
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k : i]][data[i]] += 1
    out = []
    for text in texts:
        data, total = b"\n" * order + coded(text), 0.0
        for i in range(order, len(data)):
            excluded, done = set(), False
            for k in range(order, -1, -1):
                seen = counts.get(data[i - k : i])
                if not seen:
                    continue
                free = {b: n for b, n in seen.items() if b not in excluded}
                size = sum(free.values()) + len(free)
                if data[i] in free:
                    total += math.log10(free[data[i]] / size)
                    done = True
                    break
                if free:
                    total += math.log10(len(free) / size)
                excluded |= set(seen)
            if not done:
                total -= math.log10(256 - len(excluded))
        out.append(total)
    return out


def sample(seed=4):
    random.seed(seed)
    words = [f"{a}{b}{c}" for a in ("the", "An", "é") for b in ("", "re", "st") for c in ("", "ing", ".")]
    texts = [" ".join(random.choices(words, k=random.randint(0, 30))) for _ in range(40)]
    return [*texts, None, "", "  \n", "zzz QQQ the", "the the the\nthe"]


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_against_a_plain_model(spark, order):
    texts = sample()
    rows = [(i, text, i % 3 == 0) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    got = {r["doc_id"]: r for r in score_texts(docs, Ppm(order=order, head_share=0.02)).collect()}
    train = [t for _, t, held in rows if not held]
    for (i, text, _), score in zip(rows, brute(train, texts, order)):
        assert got[i]["score"] == pytest.approx(score, abs=1e-9)
    count = Counter()
    for text in train:
        count.update([*tokens(text), None])
    n, v = sum(count.values()), len(count)
    for i, text, _ in rows:
        own = [*tokens(text), None]
        assert got[i]["n_tokens"] == len(own) and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(count[x] > 0 for x in own)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own), abs=1e-9)


def test_without_training_texts_and_rows(spark):
    docs = spark.createDataFrame([(1, "ab", True), (None, None, True)], "doc_id long, text string, held_out boolean")
    got = {r["doc_id"]: r for r in score_texts(docs).collect()}
    assert got[1]["score"] == pytest.approx(-4 * math.log10(256)) and got[1]["n_known"] == 0
    assert got[None]["score"] == pytest.approx(-math.log10(256))
    assert score_texts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order", [0, 1, 5])
def test_rare_grams_count_in_full(spark, order):
    rows = [(i, text, i % 3 == 0) for i, text in enumerate(sample(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    train = [t for _, t, held in rows if not held]
    expected = brute(train, [t for _, t, _ in rows], order)
    for share in (0.05, 1.0):
        got = {r["doc_id"]: r["score"] for r in score_texts(docs, Ppm(order=order, least_share=share)).collect()}
        assert [got[i] for i, _, _ in rows] == pytest.approx(expected, abs=1e-9)


def test_hot_grams_outside_the_head(spark, monkeypatch):
    monkeypatch.setattr("llm.ppm.BROADCAST_ROWS", 0)
    monkeypatch.setattr("llm.ppm.HOT_SHARE", 0.01)
    rows = [(i, text, i % 3 == 0) for i, text in enumerate(sample(2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, Ppm(least_share=0.1)).collect()}
    expected = brute([t for _, t, held in rows if not held], [t for _, t, _ in rows], 5)
    assert [got[i] for i, _, _ in rows] == pytest.approx(expected, abs=1e-9)

"""Removal of repeated byte strings against a plain version that counts every string."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

import llm.repeats as rp
from llm.repeats import RepeatRules, least_in_windows, refined, without_repeats
from tests.llm.helpers import docs_of


def plain(texts, length):
    raw = [(x or "").encode() for x in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append((len(x), edges.reshape(-1, 2).tolist(), bytes(np.frombuffer(x, np.uint8)[~gone])))
    return out


def check(spark, rows, rules):
    got = without_repeats(docs_of(spark, rows), "doc_id", rules).collect()
    got = sorted(((r.doc_id is not None, r.doc_id, r.n_bytes, [list(s) for s in r.spans], bytes(r.kept)) for r in got), key=repr)
    want = sorted(((i is not None, i, *x) for (i, _), x in zip(rows, plain([x for _, x in rows], rules.length))), key=repr)
    assert got == want


def patchwork(seed, n, length, alphabet="abcé中 "):
    """Texts put together from shared passages of about the length that counts, copies and noise."""
    random.seed(seed)
    noise = lambda k: "".join(random.choices(alphabet, k=k))
    passages = [noise(random.randint(length // 3, 2 * length)) for _ in range(12)]
    out = []
    for _ in range(n):
        if out and random.random() < 0.2:
            text = random.choice(out)
            if random.random() < 0.6 and text:
                at = random.randrange(len(text))
                text = text[:at] + noise(1) + text[at + 1 :]
        else:
            text = "".join(
                random.choice(passages)[random.randint(0, 5) :] if random.random() < 0.5 else noise(random.randint(0, length))
                for _ in range(random.randint(0, 6))
            )
        out.append(text)
    return out


def test_least_of_windows():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 7, 8, 73):
        value = rng.integers(0, 5, 300).astype(np.uint64)
        want = [i + int(np.argmin(value[i : i + width])) for i in range(len(value) - width + 1)]
        assert least_in_windows(value, width).tolist() == want


def test_refined_buckets_stand_for_the_first_bytes():
    random.seed(2)
    raw = "".join(patchwork(3, 20, 30, "ab")).encode()
    for length in (8, 11, 16, 30, 61):
        wanted = np.flatnonzero(np.random.default_rng(length).random(len(raw) - length + 1) < 0.6)
        by_string, by_bucket = {}, {}
        for i, bucket in zip(wanted.tolist(), refined(np.frombuffer(raw, np.uint8), length, wanted).tolist()):
            by_string.setdefault(raw[i : i + length], set()).add(bucket)
            by_bucket.setdefault(bucket, set()).add(raw[i : i + length])
        assert all(len(x) == 1 for x in (*by_string.values(), *by_bucket.values()))


def test_equals_a_plain_version(spark):
    rows = [(i, x) for i, x in enumerate(patchwork(4, 150, 40))]
    rows += [(900, None), (901, ""), (902, "x"), (None, "y" * 45), (7, rows[3][1]), (7, rows[3][1]), (8, "ab" * 90), (9, "z" * 300)]
    check(spark, rows, RepeatRules(length=40, gram=20))


def test_production_length(spark):
    rows = [(i, x) for i, x in enumerate(patchwork(5, 60, 200, "abcdefgh "))]
    exact = "".join(random.choices("pqrstuv", k=200))
    rows += [(100, "1" + exact + "2"), (101, "3" + exact), (102, exact[:199] + "!")]
    check(spark, rows, RepeatRules())


def test_crowded_buckets_are_halved(spark, monkeypatch):
    random.seed(6)
    core = "".join(random.choices("klmno", k=34))
    noise = lambda: "".join(random.choices("ab", k=8))
    rows = [(i, noise() + core + noise()) for i in range(300)]
    monkeypatch.setattr(rp, "CROWD", 6)
    check(spark, rows, RepeatRules(length=40, gram=20))


def test_blocks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(rp, "BLOCK", 64)
    rows = [(i, x) for i, x in enumerate(patchwork(7, 40, 40))]
    check(spark, rows, RepeatRules(length=40, gram=20))


def test_empty_table_and_other_columns(spark):
    assert without_repeats(docs_of(spark, []), "doc_id").count() == 0
    rows = spark.createDataFrame([(1, "t", 2, 3)], "doc_id long, text string, row int, kept int")
    assert without_repeats(rows, "doc_id").first().kept == b"t"

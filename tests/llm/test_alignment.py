"""Token alignment against a plain version that walks over tokens, and the sparse product against dense ones."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

import llm.alignment as al
from llm.alignment import Csr, TokenizerPair, align, alignments, default_tokenizers
from tests.llm.helpers import docs_of

ODD = ["the", " quick", "  ", "\n", "é", "ß中", "<|endoftext|>", "<s>", "▁", " a", "'s", "🙂", " Straße", "x" * 30, "\t", "ing"]


def spans(pieces, ids):
    at, out = 0, []
    for i in ids:
        size = int(pieces.size[i])
        out.append((i, at, at + size, bytes(pieces.raw[pieces.start[i] : pieces.start[i] + size])))
        at += size
    return out


def plain(pair, texts):
    """Per text: n_a, n_b, n_groups, n_links, n_shared, digest, and its list of linked id pairs."""
    out = []
    for text in texts:
        found = (0, 0, 0, 0, 0, "", [])
        if text:
            a = spans(pair.a_pieces, pair.a.encode(" " + text, add_special_tokens=False).ids)
            b = spans(pair.b_pieces, pair.b.encode(text))
            if all(b"".join(x[3] for x in side) == b" " + text.encode() for side in (a, b)):
                cuts = sorted({x[2] for x in a} & {x[2] for x in b})
                groups, low = [], 0
                for cut in cuts:
                    groups.append([[x[0] for x in side if low < x[2] <= cut] for side in (a, b)])
                    low = cut
                links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
                told = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
                shared = sum(len(x) * len(y) for x, y in groups)
                found = (len(a), len(b), len(groups), len(links), shared, hashlib.sha256(told.encode()).hexdigest(), links)
        out.append(found)
    return out


def whole(pair, texts):
    rows = plain(pair, texts)
    counts = Counter(p for r in rows for p in set(r[6]))
    highest = Counter()
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    return [
        (*r[:6], sum(counts[p] == highest[p[0]] for p in r[6]), sum(counts[p] for p in r[6])) for r in rows
    ]


def test_products_equal_dense_ones():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, k, m = rng.integers(1, 9, 3)
        x, y = rng.integers(0, 3, (n, k)) * (rng.random((n, k)) < 0.4), rng.integers(0, 3, (k, m)) * (rng.random((k, m)) < 0.4)
        sparse = []
        for d in (x, y):
            r, c = np.nonzero(d)
            sparse.append(Csr(np.searchsorted(r, np.arange(len(d) + 1)), c, d[r, c], d.shape[1]))
        p = sparse[0].times(sparse[1])
        dense = np.zeros((n, m), int)
        dense[p.rows(), p.column] = p.value
        assert (dense == x @ y).all()
        t = sparse[0].transposed()
        back = np.zeros((k, n), int)
        back[t.rows(), t.column] = t.value
        assert (back == x.T).all()
        v = rng.integers(0, 5, k)
        assert (sparse[0].sums(v) == x @ v).all()


def odd_texts(n, seed):
    random.seed(seed)
    return ["".join(random.choices(ODD, k=random.randint(0, 25))) for _ in range(n)]


def rows_of(out):
    return sorted(
        (r.doc_id is not None, r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_shared, r.groups_sha256, r.n_best, r.count_sum)
        for r in out.collect()
    )


def check(spark, rows):
    got = rows_of(alignments(docs_of(spark, rows), "doc_id", *default_tokenizers()))
    want = whole(TokenizerPair(*default_tokenizers()), [x for _, x in rows])
    assert got == sorted((i is not None, i, *x) for (i, _), x in zip(rows, want))


def test_equals_a_plain_version(spark):
    rows = [(i, x) for i, x in enumerate(odd_texts(250, 5))] + [(900, None), (901, ""), (902, " "), (7, "again"), (7, "again")]
    check(spark, rows)


def test_pairs_outside_the_head_are_joined(spark, monkeypatch):
    monkeypatch.setattr(al, "HEAD_PAIRS", 20)
    check(spark, [(i, x) for i, x in enumerate(odd_texts(80, 6))])
    monkeypatch.setattr(al, "HEAD_PAIRS", 0)
    check(spark, [(i, x) for i, x in enumerate(odd_texts(20, 7))])


def test_long_texts_go_part_by_part():
    memory = al.Memory(TokenizerPair(*default_tokenizers()), max_chunks=30)
    random.seed(8)
    text = " ".join(random.choices(["alpha", "Straße", "b3ta", "  gap", "x", "the", "end.", "中"], k=4000))
    raw, size = np.frombuffer(text.encode(), np.uint8), al.PART
    at_once = al._short(memory, raw, np.array([0, len(raw)]))
    al.PART = 500
    try:
        assert len(al._parts(text, 500)) > 20
        parts = al._long(memory, text)
    finally:
        al.PART = size
    assert (at_once[0] == parts[0]).all() and at_once[1] == parts[1]
    assert (at_once[2][0] == parts[2][0]).all() and (at_once[3][0] == parts[3][0]).all()
    assert al._long(memory, "a ▁ b" * 9)[1] == [""]


def test_empty_table_and_clashing_columns(spark):
    empty = docs_of(spark, [])
    assert alignments(empty, "doc_id", *default_tokenizers()).count() == 0
    rows = spark.createDataFrame([(1, "two words", 5, 6), (None, "x", 7, 8)], "doc_id long, text string, row int, pairs int")
    assert alignments(rows, "doc_id", *default_tokenizers()).count() == 2
    assert align(TokenizerPair(*default_tokenizers()), ["a"]).good[0]

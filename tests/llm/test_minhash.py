"""MinHash near-duplicates and components against brute force."""

from __future__ import annotations

import random
import re

import pytest

from llm.graph import components
from llm.minhash import MinHash, keep_first, near_duplicates
from tests.llm.helpers import docs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, size):
    bags = {}
    for i, text in rows:
        words = WORD.findall(fold(text))
        last = max(1, len(words) - size + 1)
        bags[i] = {tuple(words[k : k + size]) for k in range(last)} if words else set()
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = bags[i], bags[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(bags[i]), root(i)) for i in ids}


def corpus(seed):
    random.seed(seed)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{random.randrange(300)}" for _ in range(random.randint(1, 60))]
        for _ in range(random.randint(1, 6)):
            words = list(base)
            for _ in range(random.randint(0, 4)):
                words[random.randrange(len(words))] = f"X{random.randrange(300)}"
            rows.append((n * 7, " ".join(words)))
            n += 1
    return [*rows, (10_001, None), (10_002, ""), (10_003, " \n "), (10_004, "one"), (10_005, "ONE"), (10_006, "one two")]


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(spark, size):
    rows = corpus(size)
    got = near_duplicates(docs_of(spark, rows), settings=MinHash(shingle=size, block_rows=3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_keep_first_keeps_columns_and_handles_an_empty_table(spark):
    rows = [(5, "a b c d e f"), (2, "A b c d e f"), (9, "x y"), (None, "a b c d e f")]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS id", "2 AS rep", "3 AS component_id")
    out = keep_first(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {2, 9, None}
    assert keep_first(docs_of(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    random.seed(1)
    ids = random.sample(range(1000), 60)
    links = [*zip(ids, ids[1:]), (2000, 2001), (2001, 2000), (3000, 3000)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: min(ids) for i in ids} | {2000: 2000, 2001: 2000}

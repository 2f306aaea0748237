"""Benchmark passages: brute-force edit distance, planted passages, edges."""

from __future__ import annotations

import random

import numpy as np

from llm.decontaminate import Decontamination, _Block, banded, flagged, without_benchmark
from tests.llm.helpers import docs_of


def normal(text):
    return " ".join((text or "").lower().split())


def nearest(item, text):
    """Least edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def made(seed):
    random.seed(seed)
    letters = "abcdefgh "
    word = lambda n: "".join(random.choices(letters, k=n))
    items = [(i, word(random.randint(40, 120))) for i in range(6)] + [(90, None), (91, "  "), (92, "zq!")]
    docs = []
    for i in range(40):
        text = word(random.randint(0, 200))
        if random.random() < 0.7:
            passage = list(random.choice(items[:6])[1])
            for _ in range(random.randint(0, 14)):
                at = random.randrange(len(passage))
                passage[at : at + 1] = random.choice([[], ["X"], [passage[at], "y"]])
            text += "".join(passage).upper().replace(" ", " \n ") + word(random.randint(0, 100))
        docs.append((i, text))
    return items, [*docs, (100, None), (101, ""), (102, "has ZQ! in it")]


def test_against_edit_distance(spark):
    settings = Decontamination(block_chars=200)
    items, docs = made(5)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: {m["item_id"]: m["edits"] for m in r["matches"]} for r in flagged(docs_of(spark, docs), benchmark, settings).collect()}
    for i, text in docs:
        want = {}
        for item, passage in items:
            passage = normal(passage)
            if passage and (edits := nearest(passage, normal(text))) <= settings.edits(len(passage)):
                want[item] = edits
        assert got[i] == want, (i, text)


def test_edges(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, [(1, "some text"), (None, "some text"), (2, None)]).selectExpr("*", "1 AS item_id", "2 AS matches")
    assert flagged(docs, empty).count() == 3
    out = without_benchmark(docs, spark.createDataFrame([(1, "Some  Text")], "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted([r["doc_id"] for r in out.collect()], key=str) == [2, None]


def test_alignment_is_free_at_both_ends():
    codes = lambda s: np.array(list(map(ord, s)), np.uint32)
    assert banded(codes("abcdef"), codes("xxabXdefyy"), 2) == (2, 8, 1)
    assert banded(codes("abcdef"), codes("uvwxyz"), 3) is None


def test_no_placement_of_the_budget_is_lost():
    """Edits crowded into one part leave windows without hits there; the others must still count."""
    random.seed(11)
    settings = Decontamination()
    letters = "abcdefghijklmnopqrstuvwxyz"
    for n in (210, 260, 400):
        item = "".join(random.choices(letters, k=n))
        block = _Block([(7, item), (8, "".join(random.choices(letters, k=120)))], settings)
        k = settings.edits(n)
        places = [list(range(start, start + 8 * k, 8)) for start in (0, 22, n - 8 * k)]
        places += [sorted(random.sample(range(n), k)) for _ in range(40)]
        for at in places:
            text = list(item)
            for i in at:
                text[i] = "#"
            text = "".join(random.choices(letters, k=90)) + "".join(text) + "".join(random.choices(letters, k=300))
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            found = block.find(codes, np.array([0, len(codes)]))
            assert [(f[1], f[4]) for f in found] == [(7, k)], (n, at)

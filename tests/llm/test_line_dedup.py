"""Line dedup against brute force."""

from __future__ import annotations

import re

import pytest

from llm.line_dedup import LineDedup, dedup_lines, matched_lines
from tests.llm.helpers import docs_of, sample_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows):
    """{(id, line): (class, links, removed)} of every line with a match."""
    lines = []
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if words := WORD.findall(fold(line)):
                lines.append((i, k, tuple(words), frozenset(words)))
    lines.sort(key=lambda x: x[:2])
    classes, out = {}, {}
    for i, k, words, bag in lines:
        classes.setdefault(words, []).append((i, k))
    named = [(at[0], words, frozenset(words), at) for words, at in classes.items()]
    for first, words, bag, at in named:
        partners = [
            other[0]
            for other in named
            if other[1] != words and 5 * len(bag & other[2]) >= 4 * len(bag | other[2])
        ]
        if len(at) > 1 or partners:
            earliest = min([first, *partners])
            for place in at:
                out[place] = (first, len(partners), place > earliest)
    return out


def found(df):
    return {
        (row["doc_id"], x["line"]): ((x["class_id"], x["class_line"]), x["n_links"], x["removed"])
        for row in df.collect()
        for x in row["lines"]
    }


@pytest.mark.parametrize(
    "settings", [LineDedup(), LineDedup(hot_count=2), LineDedup(hot_count=2, block_rows=3)], ids=["plain", "hot", "split"]
)
def test_against_brute_force(spark, settings):
    rows = sample_texts(seed=3)
    assert found(matched_lines(docs_of(spark, rows), settings=settings)) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a b c d e"), (5, "x\nA B C D E\ny"), (None, "a b c d e"), (6, "e d c b a")]
    out = dedup_lines(docs_of(spark, rows).selectExpr("*", "1 AS a", "'k' AS line", "2 AS key"))
    assert out.columns == ["doc_id", "text", "a", "line", "key", "matched_lines"]
    got = {(r["doc_id"]): r["text"] for r in out.collect()}
    assert got == {1: None, 2: "", 3: "\n\n", 4: "a b c d e", 5: "x\ny", None: "a b c d e", 6: ""}
    assert dedup_lines(docs_of(spark, [])).count() == 0


def test_crowd_is_compared_blockwise(spark):
    rows = [(i, f"one two three four five six seven eight nine w{i}") for i in range(130)]
    got = found(matched_lines(docs_of(spark, rows), settings=LineDedup(block_rows=60)))
    assert {x[1] for x in got.values()} == {129}
    assert [k for k, x in got.items() if not x[2]] == [(0, 0)]

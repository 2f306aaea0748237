"""Rows that share an id are documents of their own."""

from __future__ import annotations

from llm.line_dedup import dedup_lines, drop_repeated_lines
from llm.minhash import keep_first, near_duplicates
from tests.llm.helpers import docs_of

LONG = " ".join(f"w{i}" for i in range(40))
OTHER = " ".join(f"x{i}" for i in range(40))


def test_a_line_found_nowhere_else_stays(spark):
    rows = [(1, "a b c d e f g h"), (5, "only place of this line here"), (5, "a b c d e f g h"), (6, "one two three\na b c d e f g h"), (6, "zz yy xx")]
    got = sorted((r["doc_id"], r["text"]) for r in dedup_lines(docs_of(spark, rows)).collect())
    assert got == [(1, "a b c d e f g h"), (5, ""), (5, "only place of this line here"), (6, "one two three"), (6, "zz yy xx")]
    lines = {(r["doc_id"], r["text"]): [x["line"] for x in r["matched_lines"] or []] for r in dedup_lines(docs_of(spark, rows)).collect()}
    assert lines[5, ""] == [0] and lines[6, "one two three"] == [1] and not lines[6, "zz yy xx"]


def test_the_second_of_equal_rows_goes(spark):
    rows = [(3, "p q r s t\nu v w"), (3, "p q r s t\nu v w"), (None, "p q r s t"), (None, "p q r s t")]
    got = sorted(((r["doc_id"], r["text"]) for r in drop_repeated_lines(docs_of(spark, rows)).collect()), key=str)
    assert got == [(3, "p q r s t\nu v w"), (None, "p q r s t"), (None, "p q r s t")]


def test_near_duplicates_of_shared_ids(spark):
    rows = [(5, LONG), (5, OTHER), (7, LONG + " end"), (2, OTHER), (5, LONG), (9, "alone in the world here now"), (None, LONG)]
    got = sorted(tuple(r) for r in near_duplicates(docs_of(spark, rows)).collect())
    assert got == [
        (2, 36, 2, True), (5, 36, 2, False), (5, 36, 5, False), (5, 36, 5, True), (7, 37, 5, False), (9, 2, 9, True),
    ]
    kept = sorted(((r["doc_id"], r["text"]) for r in keep_first(docs_of(spark, rows)).collect()), key=str)
    assert kept == [(2, OTHER), (5, LONG), (9, "alone in the world here now"), (None, LONG)]

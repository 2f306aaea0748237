"""Quality rules: SQL on a small table is checked by the registered query; here edges and single rules."""

from __future__ import annotations

from llm.quality import judged, keep_good
from tests.llm.helpers import docs_of

GOOD = "\n".join(" ".join(f"word{i}x{k}" for k in range(12)) + "." for i in range(6))


def test_lines_are_judged_one_by_one(spark):
    bad = ["BUY NOW THIS IS GREAT!", "home | about | contact", "All rights reserved.", "x$$$ y%%% z### ok&&&", "no no no no no no no no no no no", "oops", "wow!! wow!! wow!! wow!!"]
    row = judged(docs_of(spark, [(1, "\n".join([GOOD, *bad]))])).first()
    assert row["cleaned"] == GOOD and row["n_lines_removed"] == len(bad) and row["kept"]
    assert row["n_words"] == len("\n".join([GOOD, *bad]).split())


def test_repeated_windows_cover_their_words(spark):
    row = judged(docs_of(spark, [(1, "a b c x a b c y a b z")])).first()
    assert row["n_repeat_words"] == 6
    assert judged(docs_of(spark, [(1, "a a a a")])).first()["n_repeat_words"] == 4


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, GOOD), (5, GOOD), (5, GOOD), (6, "word " * 30_000)]
    docs = docs_of(spark, rows).selectExpr("*", "7 AS n_words", "8 AS kept", "9 AS _row", "10 AS n_chars")
    out = {(r["doc_id"], r["n_words"], r["kept"]) for r in judged(docs).collect()}
    n = len(GOOD.split())
    assert out == {(1, 0, False), (2, 0, False), (3, 0, False), (4, 1, False), (None, n, True), (5, n, True), (6, 30_000, False)}
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert [(r["text"], r["n_words"], r["n_chars"]) for r in kept.collect()] == [(GOOD, 7, len(GOOD))] * 3
    assert keep_good(docs_of(spark, [])).count() == 0

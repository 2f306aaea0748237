"""The pipeline against a brute-force version of its stages on a small corpus."""

from __future__ import annotations

import random

import corpus_pipeline
from llm.decontaminate import Decontamination
from llm.packing import Packing
from llm.tokens import Encoder, default_vocabulary
from tests.llm import test_decontaminate, test_line_dedup, test_minhash

HEADER = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    random.seed(9)
    line = lambda n: " ".join(f"w{random.randrange(4000)}" for _ in range(n)) + "."
    rows, texts = [], []
    for i in range(14):
        texts.append("\n".join(line(random.randint(12, 25)) for _ in range(5)))
    item = line(14)
    texts += [texts[2], texts[3].replace(" w", " v", 30), line(70) + "\n" + item.replace(" ", "  "), "JUNK!! " * 80, "short text.", None, ""]
    texts.append(texts[5] + "\n" + line(60))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows, [(1, item), (2, line(14))]


def brute(rows, benchmark):
    docs = {}
    for i, text, *_ in rows:  # quality: here a text is fifty words in plain lines or it goes
        words = (text or "").split()
        if len(words) >= 50 and "!!" not in text:
            docs[i] = text
    gone = {place for place, found in test_line_dedup.brute(list(docs.items())).items() if found[2]}
    for i, text in list(docs.items()):
        left = [x for k, x in enumerate(text.split("\n")) if (i, k) not in gone]
        docs[i] = "\n".join(left)
        if not docs[i].split():
            del docs[i]
    parts = test_minhash.brute(list(docs.items()), 5)
    docs = {i: text for i, text in docs.items() if parts[i][1] == i}
    settings = Decontamination()
    for i, text in list(docs.items()):
        for _, item in benchmark:
            item = test_decontaminate.normal(item)
            if test_decontaminate.nearest(item, test_decontaminate.normal(text)) <= settings.edits(len(item)):
                docs.pop(i, None)
    coder = Encoder(default_vocabulary()).tokenizer
    return {i: len(coder.encode(text, add_special_tokens=False).ids) + 1 for i, text in docs.items()}


def test_stages_follow_each_other(spark, tmp_path):
    rows, benchmark = corpus()
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        assert r["capacity"] in Packing().capacities
    want = brute(rows, benchmark)
    assert got == want and 13 < len(want) < len(rows)


def test_an_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == HEADER, name
    assert docs.count() == 0

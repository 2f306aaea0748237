"""Token files against the library, and packing against its own rules."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from llm.packing import Packing, pack, pack_lengths
from llm.store import new_folder
from llm.token_files import read_tokens, token_index, write_tokens
from llm.tokens import Encoder, default_vocabulary
from tests.llm.helpers import docs_of

ODD = list("aB.,é'ÉxZ1 \n\t!?×ñß…Σ\x1c中<|endoftext|>s'llt")


def odd_texts(n, seed=1):
    random.seed(seed)
    return ["".join(random.choices(ODD, k=random.randint(0, 40))) for _ in range(n)]


def test_encoder_equals_the_library():
    coder = Encoder(default_vocabulary(), max_words=500)  # forgets now and then
    plain = Tokenizer.from_file(default_vocabulary())  # as it is in the file
    special = ["a <|endoftext|> b", "x<|startoftext|>Y<|endoftext|>", "<|EndOfText|> <|endoftext|", "<|endoftext|>"]
    assert plain.encode(special[0], add_special_tokens=False).ids == [320, 49407, 321]
    texts = [*odd_texts(3000), None, "", "word. word, Word", *special, "", *special[:2], "end"]
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        ids, starts = coder.encode(pa.array(part, pa.string()))
        want = plain.encode_batch([x or "" for x in part], add_special_tokens=False)
        assert coder.counts(pa.array(part, pa.string())).tolist() == [len(x.ids) for x in want]
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [x.ids for x in want]


def test_files_round_trip_in_order(spark):
    rows = [(i * 3, x) for i, x in enumerate(odd_texts(60, seed=2))] + [(1000, None), (-5, "first")]
    random.shuffle(rows)
    folder = new_folder(spark, "tokens")
    write_tokens(docs_of(spark, rows).selectExpr("*", "1 AS ids", "2 AS n_tokens"), folder)
    coder = Encoder(default_vocabulary())
    start, want = 0, {}
    for i, text in sorted(rows):
        ids = [*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_index(spark, folder).collect()} == want
    assert [r["n_tokens"] for r in read_tokens(spark, folder, [1000]).collect()] == [1]


def test_empty_table_has_readable_files(spark):
    folder = new_folder(spark, "tokens")
    write_tokens(docs_of(spark, []), folder)
    assert token_index(spark, folder).count() == 0


def test_every_token_is_placed_once(spark):
    random.seed(3)
    rows = [(i, random.choice([0, 1, 5, 40, 90, 150, 301])) for i in range(400)] + [(7, 5), (None, 9), (8, None)]
    settings = Packing(capacities=(50, 100), group_rows=100)
    got = pack_lengths(spark.createDataFrame(rows, "doc_id long, n_tokens long"), settings).collect()
    assert sum(r["length"] for r in got) == sum(n or 0 for _, n in rows)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["length"], r["capacity"]))
    for places in bins.values():
        at = 0
        for offset, n, _ in sorted(places):
            assert offset == at
            at += n
        assert {c for _, _, c in places} == {50 if at <= 50 else 100} and at <= 100
    chunks = sorted((r["chunk"], r["length"]) for r in got if r["doc_id"] == next(i for i, n in rows if n == 301))
    assert chunks == [(0, 100), (1, 100), (2, 100), (3, 1)]
    assert pack_lengths(spark.createDataFrame([], "doc_id long, n_tokens long"), settings).count() == 0


def test_best_fit_takes_the_tightest_bin_and_downsizes():
    settings = Packing(capacities=(4, 10), attention=1e12, fixed=0.5)
    bins, offsets, capacity = pack(np.array([7, 6, 4, 3, 1]), settings)
    assert bins.tolist() == [0, 1, 1, 0, 2] and offsets.tolist() == [0, 0, 6, 7, 0]
    assert capacity.tolist() == [10, 10, 4]

"""Alignment of two tokenizers' tokens over the same bytes, by products of sparse incidence matrices.

A text's tokens and its bytes make a 0/1 matrix (a row per token, a column per byte), kept as CSR arrays
built here. With A and B for the two tokenizers, the product A B^T by Gustavson's row method has an entry
for each pair of tokens that share bytes: the overlap links. Places where tokens of both end cut the text
into groups; the products of the token-group matrices give the links of tokens that share a group, of which
only the number is kept, since a group may be long.

Where a space parts two visible characters, tokens of both end before it, so groups and links never cross such a
place. A task therefore aligns each different chunk between such spaces once, many at a time, and adds chunks up to texts. How many documents hold a pair of ids linked
is counted by Spark; the counts of the most frequent pairs (at most ``HEAD_PAIRS``) are broadcast, all others are joined.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm import words as w
from llm.rolling import Rolling
from llm.store import drop, written
from llm.tasks import tidy
from llm.tokens import _byte_letters

#: Texts are encoded some at a time; longer ones in parts of this many characters.
PART = 1 << 19
#: So many of the most frequent id pairs at most are broadcast with their counts (13 bytes each).
HEAD_PAIRS = 1 << 20


class Csr:
    """A sparse matrix by rows: the columns and values of row i lie at ``start[i]``..``start[i + 1]``."""

    def __init__(self, start: np.ndarray, column: np.ndarray, value: np.ndarray, columns: int):
        self.start, self.column, self.value, self.columns = start, column, value, columns

    @staticmethod
    def of_sizes(size: np.ndarray) -> "Csr":
        """Tokens by bytes: row i covers the next ``size[i]`` columns."""
        start = np.r_[0, np.cumsum(size)]
        return Csr(start, np.arange(start[-1]), np.ones(start[-1], np.int64), int(start[-1]))

    @staticmethod
    def of_owners(owner: np.ndarray, columns: int) -> "Csr":
        """One entry a row, at its owner."""
        return Csr(np.arange(len(owner) + 1), owner, np.ones(len(owner), np.int64), columns)

    def transposed(self) -> "Csr":
        """Counting sort of the entries by column; rows stay ascending within a column."""
        row = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        order = np.argsort(self.column, kind="stable")
        start = np.r_[0, np.cumsum(np.bincount(self.column, minlength=self.columns))]
        return Csr(start, row[order], self.value[order], len(self.start) - 1)

    def times(self, other: "Csr") -> "Csr":
        """The product by rows: row i is the sum of the rows k of ``other`` that i has entries for."""
        size = other.start[self.column + 1] - other.start[self.column]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(other.start[self.column], size)
        row = np.repeat(np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)), size)
        key = row * other.columns + other.column[at]
        value = np.repeat(self.value, size) * other.value[at]
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first, _ = w.runs(key)
        total = np.add.reduceat(value, first) if len(first) else value
        row, column = np.divmod(key[first], max(other.columns, 1))
        return Csr(np.searchsorted(row, np.arange(len(self.start))), column, total, other.columns)

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def sums(self, vector: np.ndarray) -> np.ndarray:
        """The product with a vector."""
        total = np.r_[0, np.cumsum(self.value * vector[self.column])]
        return total[self.start[1:]] - total[self.start[:-1]]


class Pieces:
    """The bytes of every id of a vocabulary."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[ids], size)
        return self.raw[at]


class TokenizerPair:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        back = {letter: byte for byte, letter in _byte_letters().items()}
        entries = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, number in self.a.get_vocab().items():
            entries[number] = bytes(back.get(ord(x), ord(x) & 0xFF) for x in token)
        self.a_pieces = Pieces(entries)
        self.b_pieces = Pieces([self._piece(i) for i in range(self.b.get_piece_size())])
        self.b_ids = len(self.b_pieces.size)
        numbers = [str(i) for i in range(max(len(entries), self.b_ids))]
        self.written = [x + end for end in ",|;" for x in numbers]
        self.ids = len(numbers)

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        if self.b.is_byte(number):
            return bytes([int(piece[1:-1], 16)])
        if self.b.is_control(number) or self.b.is_unknown(number):
            return b""
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids and numbers of ids per text of A and of B, each for a space and the text."""
        a = [x.ids for x in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        out = []
        for ids in (a, b):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            out += [np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes]
        return tuple(out)


def _parts(text: str, size: int) -> list[str]:
    """A long text cut before spaces between two ASCII letters, the spaces left out: no token of either spans such a cut.

    A stretch without such a place stays whole.
    """
    parts, low = [], 0
    while len(text) - low > size:
        at = low + size
        while (at := text.find(" ", at)) >= 0:
            if at + 1 < len(text) and all(x.isascii() and x.isalpha() for x in (text[at - 1], text[at + 1])):
                break
            at += 1
        if at < 0:
            break
        parts.append(text[low:at])
        low = at + 1
    return [*parts, text[low:]]


@dataclass
class Aligned:
    """The alignment of some texts; a text whose tokens do not spell it has none (``good`` false)."""

    good: np.ndarray
    a: np.ndarray
    a_text: np.ndarray
    a_group: np.ndarray
    b: np.ndarray
    b_text: np.ndarray
    b_group: np.ndarray
    group_text: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_bytes: np.ndarray
    shared: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray


def _spelled(pieces: Pieces, ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the ids of each text join to its bytes."""
    ends = np.r_[0, np.cumsum(pieces.size[ids])][np.r_[0, np.cumsum(sizes)]]
    good = np.diff(ends) == np.diff(offsets)
    text = np.repeat(np.arange(len(good)), sizes)
    mine = pieces.joined(ids[good[text]])
    place = np.repeat(np.arange(len(good)), np.diff(offsets))
    inside = good[place]
    wrong = place[inside][mine != raw[inside]]
    good[wrong] = False
    return good


def align(pair: TokenizerPair, texts: list[str]) -> Aligned:
    """Overlap links and groups of the texts, each with a space before it."""
    a, a_sizes, b, b_sizes = pair.encode(texts)
    spelled = [b" " + x.encode() for x in texts]
    raw = np.frombuffer(b"".join(spelled), np.uint8)
    offsets = np.r_[0, np.cumsum(np.fromiter(map(len, spelled), np.int64, len(texts)))]
    good = _spelled(pair.a_pieces, a, a_sizes, raw, offsets) & _spelled(pair.b_pieces, b, b_sizes, raw, offsets)
    a_text, b_text = np.repeat(np.arange(len(texts)), a_sizes), np.repeat(np.arange(len(texts)), b_sizes)
    a, a_text, b, b_text = a[good[a_text]], a_text[good[a_text]], b[good[b_text]], b_text[good[b_text]]
    a_bytes, b_bytes = Csr.of_sizes(pair.a_pieces.size[a]), Csr.of_sizes(pair.b_pieces.size[b])
    links = a_bytes.times(b_bytes.transposed())
    both = np.intersect1d(a_bytes.start[1:], b_bytes.start[1:], assume_unique=True)
    a_group, b_group = np.searchsorted(both, a_bytes.start[1:]), np.searchsorted(both, b_bytes.start[1:])
    group_text = a_text[np.searchsorted(a_bytes.start[1:], both)]
    in_groups = Csr.of_owners(b_group, len(both)).transposed()
    shared = Csr.of_owners(a_group, len(both)).sums(in_groups.sums(np.ones(len(b), np.int64)))
    return Aligned(
        good, a, a_text, a_group, b, b_text, b_group, group_text, links.rows(), links.column, links.value, shared,
        a_bytes.start[1:], b_bytes.start[1:],
    )


def _owners(x: Aligned, texts: list[str], chunks: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The chunk of each token of A and of B, when the good ones of ``texts`` are chunks joined by spaces."""
    sizes = [len(c.encode()) + 1 for t, some in enumerate(chunks) if x.good[t] for c in some]
    ends = np.cumsum(sizes) if sizes else np.zeros(0, np.int64)
    return np.searchsorted(ends, x.a_end), np.searchsorted(ends, x.b_end)


def _groups_written(pair: TokenizerPair, x: Aligned, owner: np.ndarray, n: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for the groups of each of ``n`` owners; ``owner`` is that of each token of A."""
    groups = len(x.group_text)
    a_before = np.r_[0, np.cumsum(np.bincount(x.a_group, minlength=groups))]
    b_before = np.r_[0, np.cumsum(np.bincount(x.b_group, minlength=groups))]
    word = np.empty(len(x.a) + len(x.b), np.int64)
    place = np.arange(len(x.a)) + b_before[x.a_group]
    last = np.arange(len(x.a)) + 1 == a_before[x.a_group + 1]
    word[place] = x.a + np.where(last, pair.ids, 0)
    place = np.arange(len(x.b)) + a_before[x.b_group + 1]
    last = np.arange(len(x.b)) + 1 == b_before[x.b_group + 1]
    word[place] = x.b + np.where(last, 2 * pair.ids, 0)
    # An owner's words begin with its first token of A, and end before that of the next one.
    first = np.searchsorted(owner, np.arange(n + 1))
    at = first + b_before[np.r_[x.a_group, groups][first]]
    words = [pair.written[i] for i in word.tolist()]
    at = at.tolist()
    return ["".join(words[p:q])[:-1].encode() for p, q in zip(at[:-1], at[1:])]


@dataclass
class Facts:
    """What is known of some chunks: whether they are spelled, their measures, groups, and linked id pairs (a * ids of B + b)."""

    good: np.ndarray
    measures: np.ndarray
    told: list[bytes]
    pairs: np.ndarray
    sizes: np.ndarray


def chunk_facts(pair: TokenizerPair, chunks: list[str]) -> Facts:
    """The alignments of a space and each chunk.

    Chunks that begin and end with a safe character are encoded some hundred at a time, joined by spaces: no token
    spans such a space. If a bundle is not spelled, its chunks are taken singly, as are all others.
    """
    n = len(chunks)
    out = Facts(np.zeros(n, bool), np.zeros((5, n), np.int64), [b""] * n, np.zeros(0, np.int64), np.zeros(n, np.int64))
    safe = [i for i, c in enumerate(chunks) if _SAFE.match(c[0]) and _SAFE.match(c[-1])]
    single = sorted(set(range(n)) - set(safe))
    bundles = [safe[i : i + 200] for i in range(0, len(safe), 200)]
    found = []
    for round_ in (bundles, None):
        members = round_ if round_ is not None else [[i] for i in single]
        if not members:
            continue
        groups = [[chunks[i] for i in some] for some in members]
        texts = [" ".join(g) for g in groups]
        x = align(pair, texts)
        if round_ is not None:
            single += [i for t, some in enumerate(members) if not x.good[t] for i in some]
        ids = np.array([i for t, some in enumerate(members) if x.good[t] for i in some], np.int64)
        a_owner, b_owner = _owners(x, texts, groups)
        m = len(ids)
        out.good[ids] = True
        group_owner = a_owner[np.searchsorted(x.a_group, np.arange(len(x.group_text)))]
        counted = [np.bincount(o, minlength=m) for o in (a_owner, b_owner, group_owner, a_owner[x.link_a])]
        total = np.r_[0, np.cumsum(x.shared)]
        bounds = np.searchsorted(a_owner, np.arange(m + 1))
        out.measures[:, ids] = np.array([*counted, total[bounds[1:]] - total[bounds[:-1]]])
        for i, told in zip(ids.tolist(), _groups_written(pair, x, a_owner, m)):
            out.told[i] = told
        found.append((ids[a_owner[x.link_a]], x.a[x.link_a] * pair.b_ids + x.b[x.link_b]))
    if found:
        owner, code = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(owner, kind="stable")
        out.pairs, out.sizes = code[order], np.bincount(owner, minlength=n)
    return out


class Memory:
    """The alignments of the chunks that a worker has met; it starts afresh when it has grown to its bounds.

    Chunks are known by 64-bit hashes of their bytes.
    """

    def __init__(self, pair: TokenizerPair, max_chunks: int = 500_000, max_bytes: int = 1 << 26):
        self.pair, self.max_chunks, self.max_bytes = pair, max_chunks, max_bytes
        self._forget()

    def _forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.good, self.measures, self.told, self.told_bytes = np.zeros(0, bool), np.zeros((5, 0), np.int64), [], 0
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        facts = chunk_facts(self.pair, chunks)
        if self.used + len(facts.pairs) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(facts.pairs), np.int32)])
        self.pool[self.used : self.used + len(facts.pairs)] = facts.pairs
        self.first = np.r_[self.first, self.used + np.cumsum(facts.sizes) - facts.sizes]
        self.size = np.r_[self.size, facts.sizes]
        self.used += len(facts.pairs)
        known = np.concatenate([self.known, hashes])
        slot = np.concatenate([self.slot, len(self.told) + np.arange(len(hashes))])
        order = np.argsort(known, kind="stable")
        self.known, self.slot = known[order], slot[order]
        self.good = np.r_[self.good, facts.good]
        self.measures = np.concatenate([self.measures, facts.measures], axis=1)
        self.told += facts.told
        self.told_bytes += sum(map(len, facts.told))

    def entries(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the entry of each chunk ``raw[start:end]``; new ones are encoded."""
        hashes, first, inverse = np.unique(Rolling(raw).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.told) + len(hashes) > self.max_chunks or self.told_bytes + 4 * self.used > self.max_bytes:
            self._forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.any():
            data = raw.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            self._learn(hashes[new], [data[a:b].decode() for a, b in spans])
            at = np.searchsorted(self.known, hashes)
        return self.slot[at][inverse]


#: A space between two of these parts tokens of both tokenizers: visible ASCII, and letters and signs up to U+02FF.
_SAFE = re.compile("[!-~\u00c0-\u02ff]")


def chunks_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the chunks between spaces that part tokens; these spaces belong to no chunk."""
    visible = (raw > 0x20) & (raw < 0x7F)
    lead = (raw >= 0xC3) & (raw <= 0xCB)
    opens = visible | lead
    closes = visible.copy()
    closes[1:] |= lead[:-1]
    cut = np.zeros(len(raw), bool)
    if len(raw) > 2:
        cut[1:-1] = (raw[1:-1] == 0x20) & closes[:-2] & opens[2:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    cut[edge] = False
    cut[edge - 1] = False
    at = np.flatnonzero(cut)
    begin = offsets[:-1][np.diff(offsets) > 0]
    end = offsets[1:][np.diff(offsets) > 0]
    starts, ends = np.sort(np.r_[begin, at + 1]), np.sort(np.r_[end, at])
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: Columns of a document's alignment, after its row number and id.
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def _measured(memory: Memory, raw: np.ndarray, offsets: np.ndarray):
    """Whether each text is spelled, its measures, its groups, and its pairs and times (text, pair, times; ascending)."""
    n = len(offsets) - 1
    starts, ends, text = chunks_of(raw, offsets)
    entry = memory.entries(raw, starts, ends) if len(starts) else np.zeros(0, np.int64)
    bad = np.bincount(text, weights=~memory.good[entry], minlength=n) > 0
    bounds = np.searchsorted(text, np.arange(n + 1))
    total = np.concatenate([np.zeros((5, 1), np.int64), np.cumsum(memory.measures[:, entry], axis=1)], axis=1)
    measures = total[:, bounds[1:]] - total[:, bounds[:-1]]
    measures[:, bad] = 0
    told = [memory.told[i] for i in entry.tolist()]
    at = bounds.tolist()
    groups = [b"" if x else b";".join(told[p:q]) for x, p, q in zip(bad.tolist(), at[:-1], at[1:])]
    entry, text = entry[~bad[text]], text[~bad[text]]
    size = memory.size[entry]
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(memory.first[entry], size)
    key = (np.repeat(text, size) << 31) | memory.pool[place]
    key.sort()
    first, times = w.runs(key)
    return ~bad, measures, groups, (key[first] >> 31, key[first] & 0x7FFFFFFF, times)


def _short(memory: Memory, raw: np.ndarray, offsets: np.ndarray):
    """The measures, digests of groups, pairs and their times of some texts."""
    _, measures, groups, (text, code, times) = _measured(memory, raw, offsets)
    cuts = np.searchsorted(text, np.arange(len(offsets)))[1:-1]
    digests = [hashlib.sha256(x).hexdigest() if x else "" for x in groups]
    return measures, digests, np.split(code, cuts), np.split(times, cuts)


def _long(memory: Memory, text: str):
    """The same for one long text, part by part; tokens and groups end where parts do."""
    measures, digest, codes, times = np.zeros(5, np.int64), hashlib.sha256(), [], []
    for number, part in enumerate(_parts(text, PART)):
        raw = np.frombuffer(part.encode(), np.uint8)
        good, found, groups, (_, code, n) = _measured(memory, raw, np.array([0, len(raw)]))
        if not good[0]:
            return np.zeros((5, 1), np.int64), [""], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        measures += found[:, 0]
        digest.update((b";" if number else b"") + groups[0])
        codes.append(code)
        times.append(n)
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate(times)).astype(np.int64)
    return measures[:, None], [digest.hexdigest()], [code], [n]


def _packed(parts: list[np.ndarray]) -> list[bytes]:
    return [x.astype(np.int32).tobytes() for x in parts]


def _split(piece: pa.RecordBatch):
    """Long texts alone, the others together."""
    size = pc.fill_null(pc.binary_length(piece.column("text")), 0).to_numpy(zero_copy_only=False)
    long = np.flatnonzero(size > 2 * PART)
    for low, high in zip(np.r_[0, long + 1], np.r_[long, len(size)]):
        if high > low:
            yield piece.slice(low, high - low), False
        if high < len(size):
            yield piece.slice(high, 1), True


def _aligner(byte_path: str, piece_path: str):
    names = ["row", "key", *MEASURES, "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(TokenizerPair(byte_path, piece_path))
        for batch in batches:
            for piece in w.pieces(batch, "text", PART):
                for rows, long in _split(piece):
                    if long:
                        found = _long(memory, rows.column("text")[0].as_py())
                    else:
                        found = _short(memory, *w.utf8(rows.column("text")))
                    measures, digests, codes, times = found
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("row"),
                            rows.column("key"),
                            *[pa.array(x, pa.int64()) for x in measures],
                            pa.array(digests, pa.string()),
                            pa.array(_packed(codes), pa.binary()),
                            pa.array(_packed(times), pa.binary()),
                        ],
                        names=names,
                    )

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The int32 values of a binary column and the number of each row's."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(raw.tobytes(), np.int32).astype(np.int64), np.diff(offsets) // 4


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of the task hold each pair; sent on whenever a few million have come together."""

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

    held, size = [], 0
    for batch in batches:
        held.append(_flat(batch.column("pairs"))[0])
        size += len(held[-1])
        if size > 4_000_000:
            yield sent(held)
            held, size = [], 0
    if size:
        yield sent(held)


def _head(counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least count in the head, and its pairs, counts and marks; ``HEAD_PAIRS`` at most, whatever the corpus."""
    level = F.floor(F.log2("n"))
    sizes = {r["level"]: r["pairs"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()}
    least, total = max(sizes, default=0) + 1, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= HEAD_PAIRS:
        least -= 1
        total += sizes.get(least, 0)
    head = counts.where(F.col("n") >= F.lit(2**least)).toArrow().sort_by("pair")
    return 2**least, *[head.column(c).to_numpy() for c in ("pair", "n", "best")]


def _split_by_head(batch: pa.RecordBatch, head: np.ndarray):
    """The pairs of a batch, their times and rows, their place in the head, and whether they are in it."""
    pairs, sizes = _flat(batch.column("pairs"))
    times, _ = _flat(batch.column("times"))
    row = np.repeat(np.arange(batch.num_rows), sizes)
    at = np.minimum(np.searchsorted(head, pairs), max(len(head) - 1, 0))
    known = head[at] == pairs if len(head) else np.zeros(len(pairs), bool)
    return pairs, times, row, at, known


def alignments(docs: DataFrame, key: str, byte_path: str, piece_path: str) -> DataFrame:
    """One row per row of ``docs``: key, the measures, groups_sha256, n_best and count_sum.

    ``n_shared`` is the number of token pairs that share a group. Null and empty texts, and those that the tokens of
    one side do not spell, have zeros and an empty digest. Rows stand for themselves, whether their keys are null or
    equal or not, and each counts as a document. Columns other than the key and ``text`` are left out. An empty table
    gives no rows. A link's count is how many rows hold its pair of ids linked; n_best counts the links whose count is the highest of their A id,
    ties included, and count_sum adds up the counts of all links.
    """
    spark = docs.sparkSession
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), "text")
    fields = [T.StructField("row", T.LongType()), T.StructField("key", docs.schema[key].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in MEASURES]
    fields += [T.StructField("groups_sha256", T.StringType()), *[T.StructField(c, T.BinaryType()) for c in ("pairs", "times")]]
    aligned = written(source.mapInArrow(tidy(_aligner(byte_path, piece_path)), T.StructType(fields)), "aligned")

    partial = aligned.select("pairs").mapInArrow(_counted, "pair long, n long")
    counts = written(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a_id = F.expr(f"pair div {_b_ids(piece_path)}").alias("a")
    highest = counts.groupBy(a_id).agg(F.max("n").alias("highest"))
    marked = counts.withColumn("a", F.expr(f"pair div {_b_ids(piece_path)}")).join(F.broadcast(highest), "a")
    counts, plain = written(marked.select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs"), counts
    drop(spark, plain)
    least, *arrays = _head(counts)
    head = spark.sparkContext.broadcast(tuple(arrays))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_pairs, n, best = head.value
        for batch in batches:
            _, times, row, at, known = _split_by_head(batch, known_pairs)
            row, at, times = row[known], at[known], times[known]
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for_rows = []
            for value in (times * best[at], times * n[at]) if len(n) else (times[:0], times[:0]):
                total = np.r_[0, np.cumsum(value)]
                for_rows.append(pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.int64()))
            kept = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *for_rows], names=[*kept, "best", "sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, row, _, known = _split_by_head(batch, head.value[0])
            rows = batch.column("row").take(pa.array(row[~known]))
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(pairs[~known]), pa.array(times[~known])], names=["row", "pair", "times"]
            )

    few = aligned.select("row", "pairs", "times").mapInArrow(rest, "row long, pair long, times long")
    tail = (
        few.join(counts.where(F.col("n") < least).hint("shuffle_merge"), "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("tail_best"),
            F.sum(F.col("times") * F.col("n")).alias("tail_sum"),
        )
    )
    heads = aligned.mapInArrow(
        summed, T.StructType([*fields[:-2], *[T.StructField(c, T.LongType()) for c in ("best", "sum")]])
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    out = heads.join(tail, "row", "left").select(
        F.col("key").alias(key), *MEASURES, "groups_sha256", plus("best", "tail_best").alias("n_best"),
        plus("sum", "tail_sum").alias("count_sum"),
    )
    result = written(out, "alignments")
    head.destroy()
    drop(spark, aligned, counts)
    return result


def _b_ids(piece_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return alignments(docs, "doc_id", *default_tokenizers()).withColumn("doc_id", F.col("doc_id").cast("long"))


QUERIES = {"op13_token_alignment": (op13_token_alignment, None)}

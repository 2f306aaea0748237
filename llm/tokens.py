"""Token ids of whole texts with a public tokenizer, a batch at a time.

The word-end BPE vocabulary lower-cases and drops white space, so a text's ids are those of its
words in turn. Each worker keeps the ids of words it has met (by their 64-bit hash), and only new
words go through the tokenizers library. The memory is bounded: at ``max_words`` it starts afresh.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from llm import tasks
from llm import words as w


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level BPE writes for each byte: itself if visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


def _parted(text: w.Words) -> w.Words:
    """Words with a full stop or comma after a letter cut in two, as the tokenizer does."""
    raw, last = text.raw, text.ends - 1
    mark = (raw[last] == 0x2E) | (raw[last] == 0x2C)
    before = raw[np.maximum(last - 1, 0)]
    lead = raw[np.maximum(last - 2, 0)]
    plain = ((before | 0x20) - np.uint8(0x61)) < 26
    latin = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (last - 2 >= text.starts)
    cut = np.flatnonzero(mark & (last - 1 >= text.starts) & (plain | latin))
    if len(cut):
        at = cut + 1
        text.starts = np.insert(text.starts, at, last[cut])
        ends = np.insert(text.ends, cut, last[cut])
        text.ends = ends
        text.hashes = w.hash_words(raw, text.starts, text.ends)
        extra = np.r_[0, np.cumsum(np.bincount(text.text[cut], minlength=len(text.count)))]
        text.first, text.count = text.first + extra[:-1], text.count + np.diff(extra)
        text.text = np.repeat(np.arange(len(text.first)), text.count)
    return text


class Encoder:
    """Encodes Arrow string columns as the tokenizers library does, special tokens not added.

    The library looks for the strings of special tokens before it does anything else, within words too. Texts
    with such a string go through it whole; all others word by word.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, max_words: int = 1_000_000):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.final[number] = token.endswith("</w>")
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, special))
        self.parts = regex.compile(self.PATTERN)
        self.letters = regex.compile(r"[\p{L}]+")
        self.bytes = _byte_letters()
        self.max_words = max_words
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used, self.words = np.zeros(1 << 16, np.int32), 0, 0

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each word; words of letters alone are one BPE word each."""
        found: list[list[int] | None] = []
        others = []
        normal, model = self.tokenizer.normalizer.normalize_str, self.tokenizer.model.tokenize
        for word in words:
            small = word.lower() if word.isascii() else normal(word)
            if self.letters.fullmatch(small):
                if not small.isascii():
                    small = small.encode("utf-8").decode("latin-1").translate(self.bytes)
                found.append([x.id for x in model(small)])
            else:
                found.append(None)
                others.append(word)
        if others:
            flat, sizes = self._encode_runs(others)
            flat, ends = flat.tolist(), np.cumsum(sizes).tolist()
            rest = iter([flat[a:b] for a, b in zip([0, *ends], ends)])
            found = [next(rest) if x is None else x for x in found]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def _encode_runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words, many at a time: each part that the tokenizer cuts ends in one final id."""
        ids, sizes = [], []
        groups = [words[i : i + 500] for i in range(0, len(words), 500)]
        whole = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, encoded in zip(groups, whole):
            flat = np.array(encoded.ids, np.int32)
            parts = np.fromiter((len(self.parts.findall(x.lower())) for x in group), np.int64, len(group))
            ends = np.flatnonzero(self.final[flat]) + 1 if len(flat) else np.zeros(0, np.int64)
            if len(ends) == parts.sum():
                marks = np.r_[0, ends][np.r_[0, np.cumsum(parts)]]
                ids.append(flat)
                sizes.append(np.diff(marks))
            else:
                for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False):
                    ids.append(np.array(x.ids, np.int32))
                    sizes.append(np.array([len(x.ids)]))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, text: w.Words, hashes: np.ndarray, first: np.ndarray) -> None:
        raw = text.raw.tobytes()
        words = [
            raw[a:b].decode("utf-8", "replace") for a, b in zip(text.starts[first].tolist(), text.ends[first].tolist())
        ]
        ids, sizes = self._encode_words(words)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(sizes) - sizes
        self.start, self.size = np.concatenate([self.start, starts]), np.concatenate([self.size, sizes])
        self.used += len(ids)
        known = np.concatenate([self.known, hashes])
        slot = np.concatenate([self.slot, np.arange(self.words, self.words + len(hashes))])
        order = np.argsort(known, kind="stable")
        self.known, self.slot = known[order], slot[order]
        self.words += len(hashes)

    def places(self, column) -> tuple[w.Words, np.ndarray]:
        """The words of the texts, and for each the number of its entry in ``start`` and ``size``."""
        text = _parted(w.Words(column))
        hashes, first, inverse = np.unique(text.hashes, return_index=True, return_inverse=True)
        if self.words + len(hashes) > self.max_words:
            self._forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.any():
            self._learn(text, hashes[new], first[new])
            at = np.searchsorted(self.known, hashes)
        return text, self.slot[at][inverse] if len(hashes) else np.zeros(0, np.int64)

    def _apart(self, column) -> tuple[object, np.ndarray, list[np.ndarray]]:
        """The column with texts that hold special strings made empty, the places of these, and their ids."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not self.special:
            return column, np.zeros(0, np.int64), []
        held = pc.fill_null(pc.match_substring_regex(column, self.special), False)
        at = np.flatnonzero(held.to_numpy(zero_copy_only=False))
        if not len(at):
            return column, at, []
        whole = self.tokenizer.encode_batch_fast(column.take(pa.array(at)).to_pylist(), add_special_tokens=False)
        return pc.if_else(held, pa.scalar("", column.type), column), at, [np.array(x.ids, np.int32) for x in whole]

    def counts(self, column) -> np.ndarray:
        """The number of ids of each text."""
        column, apart, ids = self._apart(column)
        text, entry = self.places(column)
        total = np.r_[0, np.cumsum(self.size[entry])]
        out = total[text.first + text.count] - total[text.first]
        out[apart] = [len(x) for x in ids]
        return out

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and where each text's begin (and the last one's end)."""
        column, apart, ids = self._apart(column)
        text, entry = self.places(column)
        size = self.size[entry]
        total = np.r_[0, np.cumsum(size)]
        at = np.arange(total[-1]) + np.repeat(self.start[entry] - total[:-1], size)
        flat, starts = self.pool[at], np.r_[total[text.first], total[-1]]
        if len(apart):
            # The ids of the texts taken apart go in where their empty places are.
            cuts = np.split(flat, starts[apart])
            flat = np.concatenate([cuts[0], *chain.from_iterable(zip(ids, cuts[1:]))])
            more = np.zeros(len(starts), np.int64)
            more[apart + 1] = [len(x) for x in ids]
            starts = starts + np.cumsum(more)
        return flat, starts


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, until a task of another kind comes."""
    return Encoder(path)


tasks.keeps(encoder.cache_clear)

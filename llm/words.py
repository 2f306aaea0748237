"""Words, lines and shingles of Arrow string columns as flat numpy arrays.

Everything here works on one Arrow batch inside a task. Words are maximal runs of bytes other than
space and 0x09-0x0D, with A-Z in lower case, and are known by a 64-bit hash of their bytes: a
polynomial over the byte values modulo 2^64, mixed at the end. Two different words of a corpus of
n words share a hash with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from llm import tasks

NEWLINE = 0x0A
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


@tasks.keeps
def _forget_long() -> None:
    """Powers beyond what usual texts need go; a very long text has asked for them."""
    for base in [b for b, known in _powers.items() if len(known) > 1 << 20]:
        del _powers[base]


def _powers_of(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept and grown per process."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        out = np.ones(size, np.uint64)
        done = 1
        step = base
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(step)
            step = step * step % (1 << 64)
            done *= 2
        _powers[base] = known = out
    return known[:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return raw + (((raw - np.uint8(0x41)) < 26).view(np.uint8) << np.uint8(5))


def find_words(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``raw``; ``cuts`` (row offsets) end words too."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (raw != 0x20) & ((raw - np.uint8(9)) > 4)
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, inside[:-1]
    before[cuts[cuts < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts[(cuts > 0) & (cuts <= len(raw))] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hashes of the words."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    values = lower(raw).astype(np.uint64)
    values += np.uint64(1)
    values *= _powers_of(_BASE, n)
    np.cumsum(values, out=total[1:])
    return mix((total[ends] - total[starts]) * _powers_of(_INVERSE, n)[starts])


class Words:
    """The words of a batch of texts: ``starts``, ``ends``, ``hashes`` and, per text, ``first``..``first+count``."""

    def __init__(self, column):
        self.raw, self.offsets = utf8(column)
        self.starts, self.ends = find_words(self.raw, self.offsets)
        self.hashes = hash_words(self.raw, self.starts, self.ends)
        bounds = np.searchsorted(self.starts, self.offsets)
        self.first, self.count = bounds[:-1], np.diff(bounds)
        self.text = np.repeat(np.arange(len(self.first)), self.count)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 18):
    """Slices of whole rows with about ``limit`` bytes of text, so that the arrays stay in the CPU caches."""
    text = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
    for start, end in zip(bounds[:-1], bounds[1:]):
        yield batch.slice(start, end - start)


def sort_in_groups(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Positions that put (group, value) pairs in ascending order; groups must be below 2^32.

    One sort of 64-bit keys does nearly all; only keys that agree in all bits kept of the value may
    be out of order, and they are put right.
    """
    bits = int(group.max()).bit_length() if len(group) else 0
    key = (group.astype(np.uint64) << np.uint64(64 - bits)) | (value >> np.uint64(bits)) if bits else value
    order = np.argsort(key)
    sorted_key = key[order]
    tie = np.flatnonzero(sorted_key[1:] == sorted_key[:-1])
    if bits and len(tie) and (value[order[tie]] != value[order[tie + 1]]).any():
        return np.lexsort((value, group))
    return order


def distinct_in_groups(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, value) pairs in ascending order."""
    order = sort_in_groups(group, value)
    group, value = group[order], value[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    return group[new], value[new]


def runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(group)])

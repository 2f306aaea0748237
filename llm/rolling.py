"""Hashes of any substrings of some bytes, as they are."""

from __future__ import annotations

import numpy as np

from llm import words as w

_BASE = 0xD1B54A32D192ED03
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """64-bit hashes: a polynomial over the byte values modulo 2^64, mixed at the end."""

    def __init__(self, raw: np.ndarray):
        values = raw.astype(np.uint64)
        values += np.uint64(1)
        values *= w._powers_of(_BASE, len(raw))
        self.total = np.empty(len(raw) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(values, out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = w._powers_of(_INVERSE, len(self.total))
        return w.mix((self.total[end] - self.total[start]) * back[start])

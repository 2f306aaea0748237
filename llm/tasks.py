"""What a Python worker gives back when a task ends: workers live on and take tasks of other stages."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Calls that empty what a module keeps between the tasks of one stage.
_kept: list[Callable[[], object]] = []


def keeps(clear: Callable[[], object]) -> Callable[[], object]:
    """Register what empties a module's cache; tasks of other modules call it."""
    _kept.append(clear)
    return clear


def _give_back() -> None:
    """Freed memory goes back to the system instead of waiting for this process to need it again."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def tidy(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """A task function that leaves no memory behind; with ``keep`` caches stay for the next task."""

    def task(batches: Iterator) -> Iterator:
        if not keep:
            for clear in _kept:
                clear()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task

"""Python workers outlive their tasks: what a task has used goes back to the machine when it ends."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

#: least seconds between two releases of a worker that works on many small groups
EVERY = 2.0
_last = 0.0


def release() -> None:
    """Free memory that Python, Arrow and the C library hold for later use."""
    global _last
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library can
        pass
    _last = time.monotonic()


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that leaves nothing behind."""

    def tidy(batches):
        yield from run(batches)
        release()

    return tidy


def _now_and_then() -> None:
    if time.monotonic() - _last > EVERY:
        release()


def released_groups(run: Callable) -> Callable:
    """The same for a function of one group or of two that belong together."""

    def one(group):
        out = run(group)
        _now_and_then()
        return out

    def two(left, right):
        out = run(left, right)
        _now_and_then()
        return out

    return two if run.__code__.co_argcount == 2 else one

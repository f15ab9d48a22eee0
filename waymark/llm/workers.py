"""What Python workers give back once a task is done.

Spark keeps a worker for the next task. Without this, allocators would keep what the largest batch so far took, beside
the heap of an executor that may be busy with quite another stage.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return unused memory to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it has no such call
        pass


def tidy(work: Work) -> Work:
    """``work`` for ``mapInArrow``, which gives back its memory at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run

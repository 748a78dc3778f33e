"""Memory of Python workers, which live on from task to task and from query to query."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def released(work: Callable) -> Callable:
    """``work`` over Arrow batches that, when its task ends, gives back to the system what the
    allocators hold on to. Otherwise a worker keeps the most that any of its tasks needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return run

"""Arrow batches of word lists in pieces, so that a task's memory does not follow the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words worked on at once; a longer list is a piece of its own.
PIECE_WORDS = 1 << 19


def pieces(lists: pa.Array) -> Iterator[pa.Array]:
    """``lists`` cut into slices of at most ``PIECE_WORDS`` words each."""
    ends = pc.cumulative_sum(lists.value_lengths().fill_null(0).cast(pa.int64())).to_numpy()
    at, done = 0, 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(ends, done + PIECE_WORDS, "right")))
        yield lists.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def offsets_of(lists: pa.Array) -> pa.Array:
    """Where the lists start in ``flatten()``, which honours slices and skips null lists."""
    ends = pc.cumulative_sum(lists.value_lengths().fill_null(0)).cast(pa.int32())
    return pa.concat_arrays([pa.array([0], pa.int32()), ends])

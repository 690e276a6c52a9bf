"""Arrow batches of texts in parts of a bounded size, so that what Python holds at once does not follow the size of a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 1 << 18


def edges(texts: pa.Array, most_bytes: int | None = None, most_rows: int | None = None) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of texts that take most_bytes at most, or are single."""
    most_bytes = PART_BYTES if most_bytes is None else most_bytes
    total, at = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most_bytes, side="right")) - 1)
        end = end if most_rows is None else min(end, at + most_rows)
        yield at, end
        at = end


def full(batch: pa.RecordBatch, left: pa.RecordBatch | None, column: str, most_bytes: int, most_rows: int | None = None) -> tuple[list[pa.RecordBatch], pa.RecordBatch | None]:
    """(runs of rows whose texts take most_bytes at most, or are single; the last run, which rows of the next batch go on with). left: such a run of the batch before."""
    b = batch if left is None else pa.concat_batches([left, batch])
    runs = [b.slice(at, end - at) for at, end in edges(b.column(column), most_bytes, most_rows)]
    return runs[:-1], runs[-1] if runs else None


def filled(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int, most_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in such runs, which don't end where a batch does."""
    left = None
    for b in batches:
        runs, left = full(b, left, column, most_bytes, most_rows)
        yield from runs
    if left is not None:
        yield left


def by_parts(f: Callable[[list], pa.Array], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """f over the texts of an array, a part at a time: only one part's texts and results are Python objects."""

    def run(texts: pa.Array) -> pa.Array:
        try:
            return pa.concat_arrays([f(texts.slice(at, end - at).to_pylist()) for at, end in edges(texts)] or [pa.array([], kind)])
        finally:
            release()

    return run


def frugal(run: Callable) -> Callable:
    """run for mapInArrow, after which a worker that waits for its next task gives free memory back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library frees memory by its own rules
        pass

"""Small helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A task works on about so many bytes of text at a time, or on one text that is longer.
SLICE_BYTES = 4 << 20


def utf8(column: pa.Array) -> pa.LargeStringArray:
    """The column as one large_string array without nulls; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and bytes of a text column, without copying the bytes."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.LargeStringArray]]:
    """Consecutive rows of the batches with at most ``limit`` bytes of text together, or one row; and their texts."""
    for batch in batches:
        column = utf8(batch.column(text))
        ends, _ = buffers(column)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), column.slice(at, to - at)
            at = to


def map_slices(work: Callable[[pa.RecordBatch, pa.LargeStringArray], pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for DataFrame.mapInArrow that applies ``work`` slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text, limit):
            yield work(batch, texts)

    return run


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``length`` places, of each segment in turn."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)

"""Arrow batches in pieces, so that a worker holds the Python objects of a few rows at a time, however many a batch has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most rows of a piece, and bytes of texts from which on one more row begins the next piece.
ROWS, BYTES = 256, 2 << 20


def pieces(batch: pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows, in order, in pieces."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    ends = np.cumsum(sizes)
    start, before = 0, 0
    while start < batch.num_rows:
        end = int(min(start + rows, max(start + 1, np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(start, end - start)
        start, before = end, ends[end - 1]


def in_pieces(*columns: pa.Array) -> Iterator[list[list]]:
    """The columns' values as Python objects, piece by piece."""
    for piece in pieces(pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))])):
        yield [c.to_pylist() for c in piece.columns]

"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows, and bytes of their texts, worked on at once inside a batch.
BLOCK, BLOCK_BYTES = 1024, 1 << 23


def _sizes(column: pa.Array) -> np.ndarray | int:
    """Bytes of each value of a column of texts or bytes; nothing for other columns."""
    kind = column.type
    if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        offsets = np.int64
    elif pa.types.is_string(kind) or pa.types.is_binary(kind):
        offsets = np.int32
    else:
        return 0
    found = column.buffers()[1]
    return np.diff(np.frombuffer(found, offsets)[column.offset : column.offset + len(column) + 1]).astype(np.int64) if found is not None and len(column) else 0


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BLOCK, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of up to ``rows`` rows with about ``most`` bytes of texts; a longer text is a part alone."""
    for batch in batches:
        total = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            total += _sizes(column)
        ends = np.cumsum(total)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(start, end - start)
            start = end


def texts(column: pa.Array) -> list[str]:
    """Null texts as empty ones."""
    return [x or "" for x in column.to_pylist()]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, and where each text starts (one more at the end); null is empty."""
    plain = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(plain.buffers()[1], dtype=np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = plain.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]

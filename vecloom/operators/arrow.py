"""Arrow helpers for operators that work on (id, vec) rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a float32 matrix; all rows must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), np.float32)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    if len(flat) % len(column) or len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names)

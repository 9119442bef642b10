"""Shared reading of embedding columns: which rows take part, and as what."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Neither null nor empty nor zero, no null, NaN or infinite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def table_dimension(good: DataFrame, vec: str) -> int:
    """The most frequent length (ties: the longer); 0 for an empty table."""
    row = good.groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return int(row["d"]) if row else 0


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) array of a list or packed binary column of equal length, in its own float type (dim < 0: bytes)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_binary(col.type):
        data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) else np.zeros(0, np.uint8)
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
        size = (off[-1] - off[0]) // max(1, len(col)) if len(col) else 8 * dim
        if dim < 0:  # plain bytes
            return data[off[0]:off[-1]].reshape(len(col), -1)
        kind = np.float32 if size == 4 * dim else np.float64
        return data[off[0]:off[-1]].view(kind).reshape(-1, dim) if len(col) else np.zeros((0, dim))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def packed(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    m = np.ascontiguousarray(m)
    width = m.dtype.itemsize * m.shape[1]
    off = np.arange(len(m) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(off), pa.py_buffer(m)])

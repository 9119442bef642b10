"""Arrow helpers for ``mapInArrow`` functions over key-sorted rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def matrix(column) -> np.ndarray:
    """Rows of equal length of a list column as a matrix (no nulls)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as an ``array<double>`` column."""
    n, d = m.shape
    return pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32),
                                    pa.array(np.ascontiguousarray(m, np.float64).ravel()))


def by_key(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """All rows of one key at a time, from rows sorted by it; only the open key is held."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        for a, b in zip(edge, np.r_[edge[1:], len(k)]):
            if held and k[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)

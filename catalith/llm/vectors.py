"""Embeddings as rows of integers, and their exact products: for operators 11 and 12."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCALE = 64
#: Components of a larger absolute value have no exact 64-bit distances.
LARGEST = 1 << 27


def integer_rows(column: pa.ListArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows kept, their matrix of floor(64 * x)).

    Kept are rows that are not null and hold neither null nor non-finite components; with ``width`` only those of exactly
    so many components. Without it shorter rows are filled with zeros up to the longest.
    """
    offsets = column.offsets.to_numpy()
    x = column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64()).to_numpy(zero_copy_only=False)
    offsets = offsets.astype(np.int64) - offsets[0]
    lengths = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    keep = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    if width is not None:
        keep &= lengths == width
    at = np.flatnonzero(keep)
    width = int(lengths[at].max(initial=0)) if width is None else width
    rows = np.zeros((len(at), width))
    columns = np.arange(width)
    inside = columns < lengths[at, None]
    rows[inside] = x[(offsets[at, None] + columns)[inside]]
    rows = np.floor(rows * SCALE)
    if np.abs(rows).max(initial=0) > LARGEST:
        raise ValueError(f"a component times {SCALE} is beyond {LARGEST}")
    return at, rows.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b`` as integers, by the fastest arithmetic that is exact."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int32)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    raise ValueError("inner products are beyond 64 bits")

"""Rows of array<float> columns as NumPy matrices, and which of them take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x width float64, usable): unusable rows are null, empty, of another width than
    the one given, zero, or hold null or non-finite components; they are zero in the matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lens = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    holes = np.asarray(flat.is_null())
    v = np.asarray(flat.fill_null(np.nan), dtype=np.float64)
    out = np.zeros((n, width))
    ok = lens == width
    starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
    if ok.any():
        at = starts[ok][:, None] + np.arange(width)
        rows = v[at]
        good = np.isfinite(rows).all(1) & ~holes[at].any(1) & (rows != 0).any(1)
        idx = np.flatnonzero(ok)
        ok[idx[~good]] = False
        out[idx[good]] = rows[good]
    return out, ok


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one without overflow."""
    big = np.abs(x).max(1, keepdims=True)
    big[big == 0] = 1
    x = x / big
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def pack(x: np.ndarray, dtype: str = "<f8") -> pa.Array:
    """Each row as little-endian bytes."""
    x = np.ascontiguousarray(x, dtype=dtype)
    return pa.array([r.tobytes() for r in x], pa.binary())


def unpack(column: pa.Array, width: int, dtype: str = "<f8") -> np.ndarray:
    """The packed rows in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width).astype(np.float64)

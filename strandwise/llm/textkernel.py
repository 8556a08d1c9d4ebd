"""NumPy kernels over Arrow text: word boundaries, 64-bit word hashes and word-shingle hashes.

Whole Arrow chunks are handled as one byte array, so no Python string is made. A word is a run of
bytes other than space and TAB..CR; A-Z may be lowered first. Hashes are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; bounds the memory of the 8-byte arrays made from them.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(0x5EED))
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES + 1
    while size < n:
        size *= 2
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def utf8_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) for slices of about CHUNK_BYTES; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(off, off[row] + CHUNK_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, raw[off[row] : off[stop]], off[row : stop + 1] - off[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more at the end)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_counts(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), np.int64)
    for row, data, off in utf8_chunks(column):
        out[row : row + len(off) - 1] = np.diff(words(data, off)[2])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _pow_tables(len(data) + 1)
    values = _BYTE_VALUE[_LOWER[data]] if lower else _BYTE_VALUE[data]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    A row of fewer than k words (but one) has its whole word sequence as the only shingle, a row
    without words the empty set.
    """
    for _, data, off in utf8_chunks(column):
        starts, ends, first = words(data, off)
        h = word_hashes(data, starts, ends)
        n = max(len(h) - k + 1, 0)
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s += h[j : j + n] * _MIX[j]
        s = mix64(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                x = (h[a:b] * _MIX[: b - a]).sum(dtype=np.uint64, keepdims=True) + _MIX[32 + b - a]
                yield mix64(x)
            else:
                yield np.zeros(0, np.uint64)

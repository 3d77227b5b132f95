"""Helpers for whole texts inside tasks: slices of Arrow batches, words, hashes.

Everything works on UTF-8 bytes in numpy, a few megabytes of text at a time, so
that memory does not depend on the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: the finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = seeded(1, 256)
_NEAR = seeded(2, 1 << 16) | np.uint64(1)
_FAR = seeded(3, 1 << 16) | np.uint64(1)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about ``most`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = 0
    ends = np.cumsum(sizes)
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (one more at the end). Null is empty."""
    flat = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[flat.offset:flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def words(raw: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the row it is in."""
    inside = ~separators[raw]
    fresh = np.zeros(len(raw) + 1, dtype=bool)
    fresh[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | fresh[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(at, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, whatever its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    index = np.arange(len(raw), dtype=np.int64)
    first = np.zeros(len(raw), np.int64)
    first[starts] = starts
    place = index - np.maximum.accumulate(first)
    value = _BYTE[raw] * _NEAR[place & 0xFFFF]
    if int((ends - starts).max()) > 0xFFFF:
        value *= _FAR[(place >> 16) & 0xFFFF]
    outside = np.ones(len(raw) + 1, np.int8)
    outside[:-1] = 0
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    value[np.cumsum(edge[:-1], dtype=np.int8) == 0] = 0
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words in one row, and their rows, in order.

    A row of fewer words, but not none, has one shingle of all its words.
    """
    n = len(hashes)
    factors = seeded(4, size) | np.uint64(1)
    counts = np.bincount(row, minlength=int(row[-1]) + 1) if n else np.zeros(0, np.int64)
    if n >= size:
        full = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            full += hashes[k:n - size + 1 + k] * factors[k]
        same = row[:n - size + 1] == row[size - 1:]
        long_values, long_rows = mix(full[same]), row[:n - size + 1][same]
    else:
        long_values, long_rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return long_values, long_rows
    first = np.searchsorted(row, short)
    total = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = counts[short] > k
        total[has] += hashes[first[has] + k] * factors[k]
    values = np.concatenate([long_values, mix(total + counts[short].astype(np.uint64))])
    rows = np.concatenate([long_rows, short])
    order = np.argsort(rows, kind="stable")
    return values[order], rows[order]


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], rows[new]

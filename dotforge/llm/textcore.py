"""Vectorised text helpers that run inside Arrow tasks.

Texts arrive as Arrow string columns; everything here works on the raw UTF-8
buffer of a batch, so no Python string is built per word.  A word is a maximal
run of bytes other than space and the five ASCII control blanks 9-13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
LIMIT = 1 << 18  # bytes of texts of a batch that are worked on at a time


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit constants derived from a counter."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(salt)) | U64(1)


def powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), _BASE, U64)
    out[0] = 1
    return np.cumprod(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each (a longer text stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (a run of bytes that are not blank), and the first word of each text."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    solid = ~blank[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash, finalised, of values[start:end] for disjoint rising runs."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    total = int(size.sum())
    at = np.cumsum(size) - size
    inside = np.arange(total) - np.repeat(at, size)
    picked = values[inside + np.repeat(starts, size)].astype(U64) + U64(1)
    return mix(np.add.reduceat(picked * powers(int(size.max()))[inside], at) + size.astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the index of each text's first word."""
    starts, ends, first = word_spans(data, offsets)
    src = FOLD[data] if fold else data
    parts = [run_hash(src, starts[i : i + 500_000], ends[i : i + 500_000]) for i in range(0, len(starts), 500_000)]
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), first


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each word (callers drop those crossing a text's end)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    p = powers(k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out += h[j : j + n] * p[j + 1]
    return mix(out)


def batches_of(batch: pa.RecordBatch, column: str = "text", limit: int = LIMIT):
    """(lo, hi, bytes, offsets) for row ranges of a batch, bounded by bytes."""
    data, off = utf8(batch.column(batch.schema.get_field_index(column)))
    for lo, hi in slices(off, limit):
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
    pa.default_memory_pool().release_unused()  # workers are kept for later stages

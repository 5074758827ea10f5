"""Whole texts of an Arrow batch as NumPy buffers, and their words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Odd multiplier of the prefix hashes, and its inverse modulo 2^64.
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def spans(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``most`` bytes; a longer text stands alone and whole.

    A null text is empty.
    """
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is executed inside: whole texts are large, and a task holds a batch on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and then what it has freed goes back to the machine: a worker that waits for its next task would keep it."""

    def and_trim(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
            if trim is not None:
                trim(0)

    return and_trim


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = 1 << max(12, (n - 1).bit_length())
        got = np.empty(size, U64)
        got[0] = 1
        have = 1
        while have < size:
            got[have : 2 * have] = got[:have] * U64(pow(base, have, 1 << 64))
            have *= 2
        _powers[base] = got
    return got[:n]


def symbols(seed: int) -> np.ndarray:
    """256 random words, one for each byte value."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of values[t] * P^t over i <= t < j, modulo 2^64."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * powers(_P, len(values)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from start to end, the same wherever they stand."""
    size = len(sums)
    return (sums[end] - sums[start]) * powers(_P_INV, size)[start]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+``, and the first word of each text (n + 1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    begins = np.flatnonzero(start)
    return begins, np.flatnonzero(end) + 1, np.searchsorted(begins, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    sums = prefix_sums(symbols(seed)[data])
    return mix(range_hash(sums, start, end) + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every run of ``size`` words inside one text."""
    counts = np.diff(first)
    starts = np.maximum(counts - size + 1, 0)
    total = int(starts.sum())
    at = np.arange(total) + np.repeat(first[:-1] - (np.cumsum(starts) - starts), starts)
    sums = prefix_sums(hashes)
    return at, mix(range_hash(sums, at, at + size))

"""Vectorised word and byte hashing over Arrow string columns.

A column's UTF-8 buffer is hashed in place: every byte is mapped to a random
64-bit value, multiplied by a power of an odd number and summed, so that the
hash of any byte range is one subtraction and one product. Work is cut into
blocks of whole texts of about ``BLOCK`` bytes, which bounds memory by the
block or the longest text.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

try:
    _libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
except OSError:
    _libc = None

BLOCK = 1 << 20
U = np.uint64
_ODD = 0x9E3779B97F4A7C15


#: Rows and bytes of an Arrow batch of whole texts; Spark's own bounds suit rows of numbers.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark) -> None:
    """Let Arrow batches hold ``BATCH_ROWS`` rows at most, so that the memory beside the heap stays small for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What lets go of memory that a worker keeps from task to task.
holders: list[Callable[[], None]] = []


def release() -> None:
    """Give memory that a task no longer needs back to the system; workers live on with what they hold."""
    for forget in holders:
        forget()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def lean(f):
    """``f`` of one group's table, or of both groups' tables, that releases memory before it ends."""
    if f.__code__.co_argcount == 2:

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return f(left, right)
            finally:
                release()

        return both

    def one(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            release()

    return one


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_BYTES = mix(np.arange(1, 257, dtype=U) * U(_ODD))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWERED, PLAIN = _BYTES[_LOWER], _BYTES
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, BLOCK + 1)
        steps = np.full(size, base, dtype=U)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row, bytes and offsets of blocks of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def prefix_sums(data: np.ndarray, table: np.ndarray = PLAIN) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * _power(_BASE, len(data) + 1)[:-1], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start] + (end - start).astype(U))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes in ``inside``, and each text's first run (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    within = inside[data]
    before = np.empty_like(within)
    before[0] = False
    before[1:] = within[:-1]
    edges = offsets[offsets < len(data)]
    before[edges] = False
    after = np.empty_like(within)
    after[-1] = False
    after[:-1] = within[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(within & ~before)
    ends = np.flatnonzero(within & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_class(keep: bytes | None = None, drop: bytes | None = None) -> np.ndarray:
    """Which bytes belong to words: those of ``keep``, or all but those of ``drop``."""
    found = np.full(256, keep is None)
    found[list(keep if keep is not None else drop)] = keep is not None
    return found


#: Lower-case ASCII letters, digits and everything beyond ASCII, with A-Z as they are lower-cased.
ALNUM = byte_class(drop=bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Everything but white space of ASCII.
SPACED = byte_class(drop=b"\x20\x09\x0a\x0b\x0c\x0d")
_WEIGHTS = mix(np.arange(11, 43, dtype=U) * U(_ODD)) | U(1)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and each text's first one; a text of fewer words gives one, no words none."""
    n = len(hashes)
    counts = np.diff(first)
    full = np.maximum(counts - width + 1, 0)
    out_counts = np.where(counts > 0, np.maximum(full, 1), 0)
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(out_counts, out=bounds[1:])
    out = np.zeros(bounds[-1], U)
    if n >= width:
        rolled = hashes[: n - width + 1] * _WEIGHTS[0]
        for k in range(1, width):
            rolled = rolled + hashes[k : n - width + 1 + k] * _WEIGHTS[k]
        at = np.repeat(first[:-1] - bounds[:-1], out_counts) + np.arange(bounds[-1])
        wide = np.repeat(full > 0, out_counts)
        out[wide] = rolled[at[wide]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = hashes[first[i] : first[i + 1]]
        out[bounds[i]] = (own * _WEIGHTS[: len(own)]).sum(dtype=U) + U(len(own))
    return mix(out), bounds

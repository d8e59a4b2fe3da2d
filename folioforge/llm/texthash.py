"""Vectorised hashing of words, shingles and windows over Arrow text columns.

Every function works on the UTF-8 bytes of a whole Arrow batch at once; no Python
string is made. Words are maximal runs of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_M64 = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (_cumulative_power(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


def _cumulative_power(base: int, size: int) -> np.ndarray:
    out = np.ones(size, dtype=np.uint64)
    done = 1
    while done < size:
        step = min(done, size - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, raw, data = column.buffers()
    if n == 0 or raw is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text and at most `rows` rows each (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < n:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), start + rows, n)
            yield batch.slice(start, end - start)
            start = end


def trimmed(run: Callable) -> Callable:
    """The function of a Python stage, which gives memory back to the system when its task ends.

    Workers wait for further tasks, and what they hold meanwhile counts against the executor.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it needs no trimming
        ctypes.CDLL(None).malloc_trim(ctypes.c_size_t(0))


def lower_ascii(buffer: np.ndarray) -> np.ndarray:
    return _LOWER[buffer]


class Words:
    """Words of a batch: byte spans, 64-bit hashes, and the range of each document."""

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray, *, hashes: bool = True):
        self.buffer, self.offsets = buffer, offsets
        n = len(buffer)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        sep = _SEP[buffer]
        before = np.empty(n, bool)
        before[0], before[1:] = True, sep[:-1]
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, sep[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = True
        after[inner - 1] = True
        self.start = np.flatnonzero(before & ~sep)
        self.end = np.flatnonzero(after & ~sep) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = span_hash(buffer, self.start, self.end) if hashes else None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hash(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time; equal spans have equal hashes wherever they lie."""
    padded = np.zeros(len(buffer) + 8, np.uint8)
    padded[:-8] = buffer
    lanes = np.ndarray(shape=(len(buffer) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each byte on
    size = end - start
    h = mix64((lanes[start] & _LANE.take(np.minimum(size, 8))) + size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    rows, at = np.flatnonzero(size > 8), 8
    while len(rows):
        left = size[rows] - at
        h[rows] = mix64(h[rows] * np.uint64(_BYTE_BASE) ^ lanes[start[rows] + at] & _LANE.take(np.minimum(left, 8)))
        rows, at = rows[left > 8], at + 8
    return h


def window_hash(values: np.ndarray, width: int, *, base: str = "word") -> np.ndarray:
    """Hash of every run of `width` values (uint64), as if the array were one document."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    powers = _WORDS if base == "word" else _BYTES
    up, down = powers.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix64((total[width:] - total[: n - width + 1]) * down[: n - width + 1])


def byte_values(buffer: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[buffer]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

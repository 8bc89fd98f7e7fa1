"""Whole texts of Arrow batches as byte blocks with word bounds and exact-width hashes, in numpy.

A block holds whole texts, at least one, and about ``BLOCK_BYTES`` of them, so the arrays
derived from it are bounded by that or by one text, whichever is larger.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F | 1)


def spaces() -> np.ndarray:
    """True at the bytes that part words: 0x20 and 0x09 to 0x0D."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


SPACE = spaces()


def fold_table() -> np.ndarray:
    """Bytes with A-Z lowered, all others unchanged."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = fold_table()


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when a longer block comes."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.n, self.up, self.down = 0, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(self.n + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly; one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Rows ``first`` to ``last`` of a batch: bytes and each text's bounds in them."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def words(self, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and each text's bounds in them (one more than texts)."""
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~parts[self.data]
        starts = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        edges = self.bounds[1:-1]
        at = edges[edges < n]
        starts[at] = inside[1:-1][at]
        at = edges[edges > 0] - 1
        ends[at] = inside[1:-1][at]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return s, e, np.searchsorted(s, self.bounds)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of the bytes from each start to its end."""
        data = self.data if data is None else data
        up, down = _BYTES.upto(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive values, at the first of each."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def planes(values: np.ndarray) -> bytes:
    """Numbers as all their first bytes, then all their second and so on: equal high bytes stand together, for shuffles to compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    """The numbers that ``planes`` took apart."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(kind).ravel()


def whole_windows(bounds: np.ndarray, width: int, n: int) -> np.ndarray:
    """True at the positions from which ``width`` values lie in one text; n - width + 1 of them."""
    if n < width:
        return np.zeros(0, bool)
    starts = np.zeros(n + 1, np.int32)
    np.add.at(starts, bounds[1:-1], 1)
    text = np.cumsum(starts[:n])
    return text[: n - width + 1] == text[width - 1 :]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def trim() -> None:
    """Gives this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for an Arrow function; at the end of a task the worker, which Spark keeps, gives its free memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return task


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column in whole-text blocks of about ``most`` bytes."""
    data, bounds = string_buffers(column)
    n, first = len(bounds) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        last = min(last, n)
        yield Block(first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last

"""Vectorised text kernels over Arrow string columns.

A text column is handled as its UTF-8 bytes and row offsets, in chunks of
whole rows; no Python string is made. Words are maximal runs of bytes other
than the six ASCII white-space bytes, and are compared by 64-bit hashes: a
polynomial over per-byte random values whose prefix sums give the hash of
any span in constant time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one call of a kernel handles, a single longer row aside.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The identity, and A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def release() -> None:
    """Give freed memory back: workers live on between stages, whose needs must not add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library
        pass


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, dtype=_U), np.full(n, _INVERSE, dtype=_U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES + 1
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[:n], down[:n]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, row offsets)`` of chunks of whole rows. Nulls are empty."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if part.null_count:
            part = part.fill_null("")
        wide = pa.types.is_large_string(part.type) or pa.types.is_large_binary(part.type)
        _, where, data = part.buffers()
        kind = np.int64 if wide else np.int32
        if not len(part):
            continue
        offsets = np.frombuffer(where, dtype=kind)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(part):
            end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
            end = min(max(end, row + 1), len(part))
            yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each row."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Spans:
    """Prefix sums of a chunk: the hash of any span of its bytes."""

    prefix: np.ndarray
    down: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Spans:
        up, down = powers(len(data) + 1)
        prefix = np.empty(len(data) + 1, dtype=_U)
        prefix[0] = 0
        np.cumsum(_VALUES[data] * up[:-1], out=prefix[1:])
        return cls(prefix, down)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts] + (ends - starts).astype(_U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offsets of each row among them."""
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)

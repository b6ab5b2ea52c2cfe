"""Array helpers on Arrow text columns, used inside Spark tasks.

A column becomes one byte buffer with row offsets. Words and hashes come from array arithmetic over the
whole buffer, in pieces of bounded size, so a task holds a few dozen megabytes whatever the batch.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_U = np.uint64


def white_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


SPACE = white_space()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offset of each row; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache
def byte_codes() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), PIECE + 2)
            with np.errstate(over="ignore"):
                one = np.ones(1, _U)
                self.up = np.multiply.accumulate(np.concatenate([one, np.full(size, self.base, _U)]))
                self.down = np.multiply.accumulate(np.concatenate([one, np.full(size, self.inverse, _U)]))
        return self.up, self.down


POWERS = (Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95))


class Rolling:
    """Hashes of any slices of a sequence of 64-bit codes, from one running sum."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        up, self.down = POWERS[which].upto(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(codes * up[:len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[end] - self.sums[start]) * self.down[start]
            return mix(raw + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each white-space separated word, and the first word of each row (one entry more than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(buf)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return Rolling(byte_codes()[buf], which).of(starts, ends)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))

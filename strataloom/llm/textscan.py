"""Word scanning of whole Arrow text batches with numpy: no Python object per word.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 equals the pattern [^\\x20\\x09-\\x0D]+.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 18
_STEP, _STEP_BACK = pow(_BASE, _CHUNK, 1 << 64), pow(_BASE_INVERSE, _CHUNK, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values that a seed determines."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = stream(1, 256)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 21, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, without a copy of the bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def tidy() -> None:
    """Give this worker's spare memory back."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidied(run):
    """run with tidy() at its end: workers outlive their tasks. Tables of this module stay out of what is sent to them."""

    def inner(batches):
        yield from run(batches)
        tidy()

    return inner


def slices(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Document ranges [lo, hi) of at most `most` bytes each; a longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi



def _spans_hashed(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The polynomial hash of data[start:stop] for sorted spans that don't overlap.

    Eight-byte values exist for one chunk of the bytes at a time, so that a long text takes a few bytes of memory for each of its own.
    """
    out, low = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    power, inverse = _powers(_BASE, _CHUNK), _powers(_BASE_INVERSE, _CHUNK)
    sums, carry, scale, back = np.zeros(_CHUNK + 1, np.uint64), np.uint64(0), 1, 1
    done_start = done_stop = 0
    with np.errstate(over="ignore"):
        for at in range(0, len(data), _CHUNK):
            part = data[at : at + _CHUNK]
            m = len(part)
            terms = _BYTE[part]
            terms *= power[:m]
            np.cumsum(terms, out=sums[1 : m + 1])
            sums[1 : m + 1] *= np.uint64(scale)
            sums[: m + 1] += carry
            i, j = int(np.searchsorted(start, at + m)), int(np.searchsorted(stop, at + m, "right"))
            here = start[done_start:i] - at
            low[done_start:i] = sums[here]
            out[done_start:i] = inverse[here] * np.uint64(back)
            high = sums[stop[done_stop:j] - at]
            out[done_stop:j] *= high - low[done_stop:j]
            done_start, done_stop, carry = i, j, sums[m]
            sums[0] = 0
            scale, back = scale * _STEP & _MASK, back * _STEP_BACK & _MASK
    return out


class Words:
    """The words of one slice: byte bounds, 64-bit hashes, and each document's first word."""

    __slots__ = ("data", "first", "hashes", "start", "stop")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, hashed: bool = True):
        base = offsets[0]
        data = data[base : offsets[-1]]
        offsets = offsets - base
        data = LOWER[data] if lower else data
        solid = ~SPACE[data]
        n = len(data)
        inner = offsets[(offsets > 0) & (offsets < n)]
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        before[inner] = False
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        after[inner - 1] = False
        self.data = data
        self.start = np.flatnonzero(solid & ~before)
        self.stop = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        if hashed:
            h = _spans_hashed(data, self.start, self.stop)
            self.hashes = mix(h + (self.stop - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

"""Vectorised views of Arrow text batches, shared by the text operators.

Every helper works on the UTF-8 bytes of a bounded slice of a batch, so memory follows ``SLICE_BYTES`` (or the single
longest text) and not the batch or the partition. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20

#: Spans of up to this many bytes are hashed eight bytes at a time for all spans at once; longer ones one by one.
SHORT = 64
#: Added to the lengths at the start, so that the two lanes of hashes have nothing in common.
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D))
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Separators of bare words: white space and ASCII punctuation.
PUNCT = SPACE.copy()
for _c in range(128):
    if not chr(_c).isalnum():
        PUNCT[_c] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offs, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return buf, o - o[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``most`` bytes, or one longer row."""
    buf, offs = utf8(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Runs:
    """Maximal runs of bytes that are no separators, never across rows: start, end, row of each, and their hashes."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE):
        inside = np.empty(len(buf) + 1, bool)
        inside[:-1] = ~separators[buf]
        inside[-1] = False
        before = np.empty(len(buf) + 1, bool)
        before[0] = False
        before[1:] = inside[:-1]
        cut = np.zeros(len(buf) + 1, bool)
        cut[offs] = True
        self.start = np.flatnonzero(inside & (cut | ~before))
        self.end = np.flatnonzero(before & (cut | ~inside))
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.buf, self.offs = buf, offs

    def __len__(self) -> int:
        return len(self.start)

    def bounds(self) -> np.ndarray:
        """Index of each row's first run, and the count: n + 1 values."""
        return np.searchsorted(self.row, np.arange(len(self.offs)))


class Hasher:
    """64-bit hashes of any spans of one buffer: of equal bytes equal, whatever their place.

    Every step mixes in whole words of eight bytes. Each step of one lane is a bijection, so pairs of spans that share a value
    can be computed: ``spans`` is for features alone. ``strong`` folds two independent lanes into 64 bits, for which no way is
    known but trying about 2**32 spans; ``pairs`` has both lanes, 128 bits together, for tables of a whole corpus.
    """

    def __init__(self, buf: np.ndarray, fold: np.ndarray | None = None):
        self.buf = np.zeros(len(buf) + 8, np.uint8)
        self.buf[:-8] = buf if fold is None else fold[buf]
        self.words = np.ndarray((len(buf) + 1,), "<u8", self.buf, 0, (1,))  # the eight bytes from each place on

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._lanes(start, end, 1)[0]

    def strong(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        first, second = self._lanes(start, end, 2)
        return mix(first + mix(second ^ _FOLD))

    def pairs(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = self._lanes(start, end, 2)
        return first, second

    def _lanes(self, start: np.ndarray, end: np.ndarray, n: int) -> list[np.ndarray]:
        size = np.asarray(end - start, np.int64)
        lanes = [mix((size.astype(np.uint64) + np.uint64(1)) * seed) for seed in _SEEDS[:n]]
        live = np.flatnonzero((size > 0) & (size <= SHORT))
        for at in range(0, SHORT, 8):
            if at:
                live = live[size[live] > at]
            if not len(live):
                break
            word = self.words[start[live] + at] & _KEEP[np.minimum(size[live] - at, 8)]
            for lane, seed in zip(lanes, _SEEDS, strict=False):
                lane[live] = mix((lane[live] ^ word) * seed)
        long = np.flatnonzero(size > SHORT)
        if len(long):
            raw = memoryview(self.buf)
            for s, e, i in zip(start[long].tolist(), end[long].tolist(), long.tolist(), strict=True):
                for k, lane in enumerate(lanes):
                    lane[i] = xxhash.xxh3_64_intdigest(raw[s:e], k)
        return lanes


def windows(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``size`` adjoining runs of one row, and the index of the first of each; mixed at every step, as a sum of
    products could be solved for."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[:n] == row[size - 1 :])
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        out = mix((out ^ h[first + k]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1))
    return out, first


def char_offsets(buf: np.ndarray) -> np.ndarray:
    """Code points before each byte position of a buffer: n + 1 values."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of start[i] .. start[i] + length[i] - 1."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - ends + length, length)

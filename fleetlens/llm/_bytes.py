"""Numpy helpers over Arrow binary columns: rolling hashes, words and lines of many texts at once.

A column's texts lie behind each other in one buffer, so one pass of array operations serves a whole batch and no Python
object is made for a word, a line or a position.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Multiplier of the rolling hash; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: White space of every contract here: bytes 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string or binary column behind each other, and the n + 1 offsets; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least n of them."""
    return _powers(1 << max(16, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any windows of a buffer; equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        x = data.astype(np.uint64)
        x += np.uint64(1)
        x *= power[:n]
        np.cumsum(x, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end))

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Cheaper and less even than hash()."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def order_of(x: np.ndarray, bits: int) -> np.ndarray:
    """A stable order of numbers below 2 ** bits, in passes of 16 bits."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort(((x >> shift) & 0xFFFF).astype(np.uint16)[order], kind="stable")]
    return order


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word, in order; words do not cross texts."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    a, b = off[:-1][full], off[1:][full] - 1
    first[a] |= inside[a]
    last[b] |= inside[b]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without the line feed) and text number of each line; a text of b bytes with k line feeds has k + 1."""
    feeds = np.flatnonzero(data == 10)
    doc = np.searchsorted(off, feeds, "right") - 1
    start = np.concatenate([off[:-1], feeds + 1])
    owner = np.concatenate([np.arange(len(off) - 1), doc])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    if len(start):
        closing = np.append(owner[1:] != owner[:-1], True)
        end[closing] = off[1:][owner[closing]]
    return start, end, owner


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes; a shorter text is one shingle, an empty one has none."""
    data = LOWER[data]
    start, end, doc = words(data, off)
    h = Rolling(data).hash(start, end)
    n = len(h)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out[: max(0, n - i)] = out[: max(0, n - i)] * np.uint64(0xD6E8FEB86659FD93) + h[i:]
    out = mix(out)
    edge = np.searchsorted(doc, np.arange(len(off)))
    sets = []
    for d in range(len(off) - 1):
        a, b = edge[d], edge[d + 1]
        if b - a >= k:
            sets.append(np.unique(out[a : b - k + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = _fold(x, w)
            sets.append(np.array([x], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _fold(x: np.uint64, w: np.uint64) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([x], np.uint64) * np.uint64(0xA0761D6478BD642F) + w)[0]


def planes(x: np.ndarray) -> bytes:
    """Sorted 64-bit keys, byte by byte from the highest: the leading bytes then compress well in a shuffle."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(">u8").reshape(-1).astype(np.uint64)

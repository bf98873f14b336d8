"""Words of whole texts as one stream of arrays, in windows of bounded bytes and rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from fleetlens.llm._bytes import LOWER, texts

WINDOW_BYTES = 1 << 20


class Words(NamedTuple):
    """Words in order: the row that each is of, its length in bytes, whether a piece begins with it; and the bytes of all."""

    row: np.ndarray
    size: np.ndarray
    opens: np.ndarray
    body: np.ndarray

    def strings(self) -> pa.Array:
        return joined(self.body, self.size)


def joined(body: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary array of the values that lie behind each other in body."""
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(body))])


def _end(data: np.ndarray, word: np.ndarray, at: int, stop: int) -> int:
    """The first place from at on, stop at the latest, where no word goes on; A-Z go on a word as their small letters do."""
    while at < stop:
        part = word[LOWER[data[at : min(stop, at + 4096)]]]
        if not part.all():
            return at + int(np.argmin(part))
        at += len(part)
    return stop


def words(column, word: np.ndarray, breaks: np.ndarray | None = None, window: int = WINDOW_BYTES, rows: int = 256) -> Iterator[Words]:
    """Lower-cased (A-Z) words of a column: runs of bytes where the table word is true. A piece ends with its text and at bytes
    where breaks is true. A window has about window bytes of at most so many rows, and ends between two words.
    """
    data, off = texts(column)
    at, n = 0, len(data)
    last, pending = -1, True
    while at < n:
        row = int(np.searchsorted(off, at, "right")) - 1
        stop = int(off[min(row + rows, len(off) - 1)])
        b = min(at + window, stop)
        if b < stop:
            b = _end(data, word, b, int(off[int(np.searchsorted(off, b, "left"))]))
        x = LOWER[data[at:b]]
        inside = word[x]
        first, final = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        final[:-1] &= ~inside[1:]
        edge = off[np.searchsorted(off, at, "right") : np.searchsorted(off, b, "left")] - at
        first[edge] |= inside[edge]
        final[edge - 1] |= inside[edge - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(final) + 1
        broken = np.cumsum(breaks[x]) if breaks is not None else np.zeros(len(x), np.int8)
        if len(start):
            of = np.searchsorted(off, at + start, "right") - 1
            mark = broken[start]
            opens = np.append(True, (of[1:] != of[:-1]) | (mark[1:] != mark[:-1]))
            opens[0] = pending or of[0] != last or mark[0] > 0
            yield Words(of, end - start, opens, x[inside])
            last, pending = int(of[-1]), bool(broken[-1] != mark[-1])
        else:
            pending = pending or bool(broken[-1])
        at = b

"""Words of whole texts as numpy arrays, straight from the bytes of an Arrow string column.

A word is a run of bytes other than space and \\x09-\\x0D, so a text is never decoded to find its
words. Texts are read in windows of a few MB that end at a separator; only a single word longer
than a window makes one larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

WINDOW_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


np.seterr(over="ignore")  # hashes wrap around


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes between terms: every ASCII character but letters and digits.
NOT_TERM = np.ones(256, dtype=bool)
NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, WINDOW_BYTES + 1)
        table = np.full(size, _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if size > 4 * WINDOW_BYTES:
            return table
        _powers[kind] = have = table
    return have[:n]


@dataclass
class Buffer:
    """The bytes of a string column and where each row's text lies in them."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def buffer_of(column: pa.Array | pa.ChunkedArray) -> Buffer:
    """Null texts become empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.string()), False
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return Buffer(np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64))
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    start, end = off[:-1].copy(), off[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        end[gone] = start[gone]
    return Buffer(raw, start, end)


@dataclass
class Words:
    """start, end: byte positions in the buffer; row: the text's row; hash: 64 bits of the word's bytes."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Hashes of many byte ranges of `data`; equal bytes give equal hashes wherever they lie."""
    if not len(start):
        return np.zeros(0, np.uint64)
    base, top = int(start.min()), int(end.max())
    sums = np.zeros(top - base + 1, np.uint64)
    np.multiply(code[data[base:top]], _power_table("up", top - base), out=sums[1:])
    np.cumsum(sums, out=sums)
    s, e = start - base, end - base
    got = (sums[e] - sums[s]) * _power_table("down", top - base + 1)[s]
    return mix(got + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _windows(buf: Buffer, rows: slice, gaps: np.ndarray) -> Iterator[tuple[int, int]]:
    at, top = int(buf.start[rows.start]), int(buf.end[rows.stop - 1])
    while at < top:
        cut = min(at + WINDOW_BYTES, top)
        while cut < top and not gaps[buf.data[cut]]:
            tail = np.flatnonzero(gaps[buf.data[cut : min(cut + 4096, top)]])
            cut = cut + int(tail[0]) if len(tail) else min(cut + 4096, top)
        yield at, cut
        at = cut


def row_groups(buf: Buffer, most_bytes: int = WINDOW_BYTES) -> Iterator[slice]:
    """Runs of rows whose texts hold about `most_bytes` in all; a longer text is a run of its own."""
    n = len(buf.start)
    at = 0
    while at < n:
        stop = int(np.searchsorted(buf.end, buf.start[at] + most_bytes, side="right"))
        stop = min(max(stop, at + 1), n)
        yield slice(at, stop)
        at = stop


def words_of(buf: Buffer, rows: slice, code: np.ndarray = BYTE_CODE, gaps: np.ndarray = SEPARATOR) -> Words:
    """The words of a run of rows, in order; gaps: the bytes that separate them."""
    parts = []
    edges = buf.start[rows]
    for lo, hi in _windows(buf, rows, gaps):
        gap = gaps[buf.data[lo:hi]]
        first = np.empty(hi - lo, dtype=bool)
        first[0] = True
        first[1:] = gap[:-1]
        inside = edges[(edges >= lo) & (edges < hi)] - lo
        first[inside] = True  # a text begins here, whatever ends the one before
        start = np.flatnonzero(first & ~gap)
        if not len(start):
            continue
        stop = np.append(gap, True)
        stop[inside] = True
        stops = np.flatnonzero(stop)
        end = stops[np.searchsorted(stops, start, side="right")]
        parts.append((start + lo, end + lo, range_hashes(buf.data, start + lo, end + lo, code)))
    if not parts:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, np.uint64))
    start = np.concatenate([p[0] for p in parts])
    end = np.concatenate([p[1] for p in parts])
    filled = np.flatnonzero(buf.end[rows] > buf.start[rows]) + rows.start
    row = filled[np.searchsorted(buf.start[filled], start, side="right") - 1]
    keep = end <= buf.end[row]  # bytes between rows belong to null texts
    if not keep.all():
        start, end, row = start[keep], end[keep], row[keep]
        return Words(start, end, row, np.concatenate([p[2] for p in parts])[keep])
    return Words(start, end, row, np.concatenate([p[2] for p in parts]))


def window_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of `size` words inside one text."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    got = np.zeros(n, np.uint64)
    for k in range(size):
        got = got * np.uint64(_BASE) + w.hash[k : k + n]
    same = w.row[:n] == w.row[size - 1 :]
    return w.row[:n][same], mix(got[same])


class Remembered:
    """Ids of words by the words' hashes: a large sorted table, a small one of late words, and their ids end to end.

    It holds `most` words; words that come later are looked up anew each time, so what it holds
    stays bounded and, words being as uneven as they are, serves nearly all of a corpus.
    """

    #: Late words that are put among the others.
    LATE = 50_000

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.old, self.late = self._empty(), self._empty()
        self.ids, self.used = np.zeros(0, np.uint32), 0

    def __len__(self) -> int:
        return len(self.old[0]) + len(self.late[0])

    @staticmethod
    def _empty() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]

    def _append(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(first, count) of each word's ids, put after those in use."""
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(count.sum())
        first = self.used + np.cumsum(count, dtype=np.int64) - count
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(total + self.used // 2, np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.used += total
        return first, count

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, first, count) of each key."""
        found = np.zeros(len(keys), dtype=bool)
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for table in (self.old, self.late):
            left = np.flatnonzero(~found)
            if not len(table[0]) or not len(left):
                continue
            at = np.searchsorted(table[0], keys[left])
            at[at == len(table[0])] = 0
            hit = table[0][at] == keys[left]
            left, at = left[hit], at[hit]
            found[left], first[left], count[left] = True, table[1][at], table[2][at]
        return found, first, count

    def take(self, hashes: np.ndarray, learn: Callable[[np.ndarray], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in order, number of ids of each); learn: ids of the words at some places."""
        inverse, keys = pd.factorize(hashes)
        seen = np.empty(len(keys), np.int64)
        seen[inverse[::-1]] = np.arange(len(hashes))[::-1]
        found, first, count = self.known(keys)
        before = self.used
        new = np.flatnonzero(~found)
        if len(new):
            first[new], count[new] = self._append(learn(seen[new]))
        at, size = first[inverse], count[inverse]
        spots = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        got = self.ids[spots]
        if len(new) and len(self) + len(new) <= self.most:
            self.late = self._merged(self.late, (keys[new], first[new], count[new].astype(np.int32)))
            if len(self.late[0]) > self.LATE:
                self.old, self.late = self._merged(self.old, self.late), self._empty()
        else:
            self.used = before
        return got, size

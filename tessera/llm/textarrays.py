"""Words of whole Arrow text columns as numpy arrays, without Python strings.

A column is handled in runs of whole rows of about ``RUN_BYTES`` each, so that the
temporary arrays stay small whatever the batch holds; a single longer text is
its own run.  Null is a text without words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20

#: byte -> byte with A-Z lower-cased
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NOT_ALNUM = np.zeros(256, bool)
_NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: separators of the two word classes, over lower-cased bytes
BLANKS, NON_ALNUM = ~_SPACE, ~_NOT_ALNUM

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        more = np.full(max(n, 64, 2 * len(_POWERS)), _BASE, np.uint64)
        more[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(more)
    return _POWERS


@dataclass
class Run:
    """Some whole rows of a text column: their bytes and where each row begins and ends in them."""

    first: int
    begin: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.begin) - 1


def runs(column: pa.Array, most: int = RUN_BYTES) -> Iterator[Run]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, n)
        yield Run(i, at[i : j + 1] - at[i], raw[at[i] : at[j]])
        i = j


@dataclass
class Words:
    """Words of a run: byte span, hash and row of each, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    per_row: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.per_row)))

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_row)), self.per_row)


def words(run: Run, inside: np.ndarray) -> Words:
    """Words of lower-cased ``run``: maximal stretches of bytes with ``inside``; no word spans two rows."""
    low = LOWER[run.data]
    mask = inside[low]
    cut = np.zeros(len(mask) + 1, bool)
    cut[run.begin] = True
    before = np.concatenate(([False], mask[:-1]))
    after = np.concatenate((mask[1:], [False]))
    start = np.flatnonzero(mask & (~before | cut[:-1]))
    end = np.flatnonzero(mask & (~after | cut[1:])) + 1
    size = end - start
    per_row = np.diff(np.searchsorted(start, run.begin))
    if not len(start):
        return Words(start, end, np.zeros(0, np.uint64), per_row)
    with np.errstate(over="ignore"):
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        value = _BYTE[low[mask]] * _powers(int(size.max()))[place]
        hashed = mixed(np.add.reduceat(value, begin) + size.astype(np.uint64))
    return Words(start, end, hashed, per_row)


def windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of ``width`` words; a row of fewer words, but not none, is one window."""
    with np.errstate(over="ignore"):
        counts = np.where(w.per_row >= width, w.per_row - width + 1, (w.per_row > 0).astype(np.int64))
        total = np.zeros(len(w.hash), np.uint64)
        n = len(w.hash)
        for j in range(min(width, n)):
            total[: n - j] += w.hash[j:] * _STEP[j]
        first = w.first[:-1]
        short = np.flatnonzero((w.per_row > 0) & (w.per_row < width))
        for r in short:
            own = w.hash[first[r] : first[r] + w.per_row[r]]
            total[first[r]] = (own * _STEP[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
        begin = np.repeat(first, counts)
        rank = np.arange(len(begin)) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        return mixed(total[begin + rank]), np.repeat(np.arange(len(counts)), counts)


@dataclass
class Lines:
    """Lines of a run, split at \\n: byte span, stripped span, and for the long ones a hash of their key."""

    start: np.ndarray
    end: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray
    per_row: np.ndarray
    long: np.ndarray
    hash: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.per_row)))


def lines(run: Run, least: int) -> Lines:
    """A line's key is the line without blanks at its ends, A-Z lower-cased; ``long``: of at least ``least`` code points."""
    data, begin = run.data, run.begin
    feed = np.flatnonzero(data == 0x0A)
    row_of_feed = np.searchsorted(begin, feed, "right") - 1
    per_row = np.bincount(row_of_feed, minlength=run.rows) + 1
    first = np.concatenate(([0], np.cumsum(per_row)))
    start = np.zeros(first[-1], np.int64)
    end = np.zeros(first[-1], np.int64)
    start[first[:-1]] = begin[:-1]
    end[first[1:] - 1] = begin[1:]
    after = np.ones(first[-1], bool)
    after[first[:-1]] = False
    start[after] = feed + 1
    before = np.ones(first[-1], bool)
    before[first[1:] - 1] = False
    end[before] = feed
    solid = np.flatnonzero(~_SPACE[data])
    lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = hi > lo
    key_start, key_end = start.copy(), start.copy()
    key_start[some] = solid[lo[some]]
    key_end[some] = solid[hi[some] - 1] + 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = points[key_end] - points[key_start] >= least
    hashed = np.zeros(len(start), np.uint64)
    which = np.flatnonzero(long)
    if len(which):
        size = (key_end - key_start)[which]
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        with np.errstate(over="ignore"):
            value = _BYTE[LOWER[data[np.repeat(key_start[which], size) + place]]] * _powers(int(size.max()))[place]
            hashed[which] = mixed(np.add.reduceat(value, at) + size.astype(np.uint64))
    return Lines(start, end, key_start, key_end, per_row, long, hashed)

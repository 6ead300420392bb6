"""An FM-index over integer sequences: suffix array, wavelet matrix ranks, backward search, sampled locate."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; a shorter suffix sorts before a longer one that it begins."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    step = np.concatenate(([0], np.cumsum(np.diff(text[order]) != 0)))
    rank[order] = step
    width = 1
    while n and step[-1] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank[order] = step
        width *= 2
    return order


class FMIndex:
    """Of ``text``: symbols from 1 up; 0 marks where no pattern may pass."""

    def __init__(self, text: np.ndarray, symbols: int):
        own = np.concatenate((text + 1, [0]))  # the end mark is unique and least
        self.size, self.symbols = len(own), symbols + 2
        rows = suffix_array(own)
        last = own[rows - 1]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=self.symbols))))
        self.levels = max(1, int(self.symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        now = last
        for level in reversed(range(self.levels)):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(self.size - int(self.ones[-1][-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.last = last
        self.sampled = rows % SAMPLE == 0
        self.sample_of = np.cumsum(self.sampled) - 1
        self.samples = rows[self.sampled]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the first ``upto`` places of the transform."""
        lo, hi = np.zeros_like(upto), upto
        for k, level in enumerate(reversed(range(self.levels))):
            bit = (symbol >> level) & 1 == 1
            ones_lo, ones_hi = self.ones[k][lo], self.ones[k][hi]
            lo = np.where(bit, self.zeros[k] + ones_lo, lo - ones_lo)
            hi = np.where(bit, self.zeros[k] + ones_hi, hi - ones_hi)
        return hi - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (from, to) of each pattern of one width, by backward search of all of them at once."""
        begin = np.zeros(len(patterns), np.int64)
        end = np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for j in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, j] + 1
            begin[alive] = self.below[symbol] + self.rank(symbol, begin[alive])
            end[alive] = self.below[symbol] + self.rank(symbol, end[alive])
            alive = alive[begin[alive] < end[alive]]
            if not len(alive):
                break
        end = np.maximum(begin, end)
        return begin, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the transform to a sampled suffix."""
        at, walked = rows.copy(), np.zeros(len(rows), np.int64)
        moving = np.flatnonzero(~self.sampled[at])
        while len(moving):
            symbol = self.last[at[moving]]
            at[moving] = self.below[symbol] + self.rank(symbol, at[moving])
            walked[moving] += 1
            moving = moving[~self.sampled[at[moving]]]
        return self.samples[self.sample_of[at]] + walked

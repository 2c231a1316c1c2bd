"""A compressed FM-index over a sequence of small integers, with a wavelet matrix
whose bit vectors are packed and ranked by popcount. Queries are vectorised."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with rank: ones before a position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)]), bitorder="little")
        self.cells = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.cells))[:-1]]).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        cell, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.cells[cell] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[cell].astype(np.int64) + np.bitwise_count(low)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, kinds: int):
        self.depth = max(1, int(kinds - 1).bit_length())
        self.levels, self.zeros = [], []
        for shift in range(self.depth - 1, -1, -1):
            bits = (values >> shift & 1).astype(bool)
            self.levels.append(Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            values = np.concatenate([values[~bits], values[bits]])
        symbols = np.arange(kinds)
        self.base = self._walk(symbols, np.zeros(kinds, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(at)
            at = np.where(symbol >> (self.depth - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._walk(symbol, at) - self.base[symbol]


class FMIndex:
    """Index of ``text`` (symbols from 1 on; 0 separates pieces). Suffixes are sorted
    by their first ``depth`` symbols, which is all that matches of that length need."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        order = np.argsort(text, kind="stable")
        rank, known = self._dense(text[order], order, n), 1
        while known < depth:
            key = rank * (n + 1)
            key[: n - known] += rank[known:] + 1
            order = np.argsort(key, kind="stable")
            rank, known = self._dense(key[order], order, n), known * 2
        self.places = order
        kinds = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        self.last = WaveletMatrix(text[order - 1], kinds)  # of the first suffix: the last symbol
        self.size = n

    @staticmethod
    def _dense(keys: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if n else 0
        return rank

    def matches(self, stream: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each end in ``stream`` the length, ``most`` at most, of
        the longest run of symbols up to it that the text has, by backward
        search, and the interval of its suffixes."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        length = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for back in range(most):
            at = ends[live] - 1 - back
            live, at = live[at >= 0], at[at >= 0]
            symbol = stream[at]
            held = (symbol > 0) & (symbol < len(self.first) - 1)
            live, symbol = live[held], symbol[held]
            lo = self.first[symbol] + self.last.rank(symbol, low[live])
            hi = self.first[symbol] + self.last.rank(symbol, high[live])
            more = lo < hi
            live = live[more]
            low[live], high[live] = lo[more], hi[more]
            length[live] += 1
        return length, low, high

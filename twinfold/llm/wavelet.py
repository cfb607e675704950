"""A wavelet tree over a sequence of whole numbers: reports the places in a range of the sequence whose values lie in a range.

Level by level, the values' bits from the highest down are stored in the order in which the level above dealt them, zeros before
ones; a range of places goes to one range among the zeros and one among the ones. Many queries go down together.
"""

from __future__ import annotations

import numpy as np

#: Ranges that are followed at once.
_CHUNK = 1 << 18


class WaveletTree:
    def __init__(self, values: np.ndarray):
        """values: a permutation of 0 .. n - 1, or any whole numbers from 0 below 2 ** 31."""
        now = np.asarray(values, np.int64)
        self.n, self.bits = len(now), max(1, int(now.max()).bit_length() if len(now) else 1)
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = now >> level & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for each place in low <= place < high whose value is in least <= value < end. Queries are dealt in chunks; each has a row of all four."""
        found = [self._report(np.arange(a, min(a + _CHUNK, len(low))), *(x[a : a + _CHUNK] for x in (low, high, least, end))) for a in range(0, len(low), _CHUNK)]
        return (np.concatenate([q for q, _ in found]), np.concatenate([v for _, v in found])) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _report(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = np.zeros(len(query), np.int64)
        query, low, high, least, end = (np.asarray(x, np.int64) for x in (query, low, high, least, end))
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            size = 1 << self.bits - 1 - k  # values below a node of the next level
            a, b = ones[low], ones[high]
            sides = []
            for side in (0, 1):
                start = base + size * side
                lo, hi = (zeros + a, zeros + b) if side else (low - a, high - b)
                keep = (lo < hi) & (start < end) & (start + size > least)
                sides.append([x[keep] for x in (query, lo, hi, least, end, start)])
            query, low, high, least, end, base = (np.concatenate(x) for x in zip(*sides, strict=True))
        times = high - low
        return np.repeat(query, times), np.repeat(base, times)

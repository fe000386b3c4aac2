"""Wavelet matrix over a numpy array: rank and range successor for many queries at once."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class WaveletMatrix:
    """Values below 2**bits.  Each level keeps one bit a value, packed, with a running count for every 64."""

    def __init__(self, values: np.ndarray):
        v = np.asarray(values, np.int64)
        self.n, self.bits = len(v), max(1, int(v.max(initial=0)).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (v >> bit) & 1
            packed = np.zeros(8 * (self.n // 64 + 1), np.uint8)
            packed[:(self.n + 7) // 8] = np.packbits(ones.astype(np.uint8), bitorder="little")
            words = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((bit, words, before, self.n - int(ones.sum())))
            v = np.concatenate([v[ones == 0], v[ones == 1]])

    @staticmethod
    def _ones(words, before, at):
        w = at >> 6
        return before[w] + np.bitwise_count(words[w] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of values[lo:hi] are less than x."""
        lo, hi, count = lo.astype(np.int64), hi.astype(np.int64), np.zeros(len(lo), np.int64)
        for bit, words, before, zeros in self.levels:
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            up = (x >> bit) & 1 == 1
            count += np.where(up, (hi - b) - (lo - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return np.where(x >> self.bits > 0, -1, count)

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0) in values[lo:hi]; 0 <= k < hi - lo."""
        lo, hi, k, out = lo.astype(np.int64), hi.astype(np.int64), k.astype(np.int64), np.zeros(len(lo), np.int64)
        for bit, words, before, zeros in self.levels:
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            low = (hi - b) - (lo - a)
            up = k >= low
            out |= np.where(up, 1 << bit, 0)
            k = np.where(up, k - low, k)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return out

    def neighbours(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x, which is one of values[lo:hi]: the greatest smaller and the least greater one there (-1: none)."""
        size, at = hi - lo, self.below(lo, hi, x)
        prev, after = np.full(len(x), -1, np.int64), np.full(len(x), -1, np.int64)
        has = at > 0
        prev[has] = self.smallest(lo[has], hi[has], at[has] - 1)
        has = at + 1 < size
        after[has] = self.smallest(lo[has], hi[has], at[has] + 1)
        return prev, after

"""Elias-Fano sequences: sorted integers in about two bits each plus their low bits, with vectorised search."""

from __future__ import annotations

import numpy as np


class EliasFano:
    """A strictly increasing sequence of non-negative integers below ``universe``.

    The low ``bits`` bits stand packed in ``low``; the high parts are a bitmap ``high`` with a one for each element and a
    zero at the end of each bucket of equal high parts."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self._ends: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        high = (v >> np.uint64(bits)).astype(np.int64)
        ones = high + np.arange(n)
        bitmap = np.zeros(int(universe >> bits) + n + 2, np.uint8)
        bitmap[ones] = 1
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            part = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << off)
            over = off + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        return cls(n, bits, low, np.packbits(bitmap, bitorder="little"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = np.take(self.low, word) >> off
        second = np.where(off > 0, np.take(self.low, np.minimum(word + 1, len(self.low) - 1)) << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (first | second) & np.uint64((1 << self.bits) - 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the index of the first element that is not smaller (n if there is none)."""
        if self._ends is None:  # of each bucket: the number of elements up to its end
            zeros = np.flatnonzero(np.unpackbits(np.asarray(self.high), bitorder="little") == 0)
            zeros -= np.arange(len(zeros))
            self._ends = zeros.astype(np.int32 if self.n < 1 << 31 else np.int64)
        x = np.asarray(x, np.uint64)
        h = np.minimum((x >> np.uint64(self.bits)).astype(np.int64), len(self._ends) - 1)
        lo = np.where(h > 0, self._ends[np.maximum(h - 1, 0)], 0).astype(np.int64)
        hi = np.minimum(self._ends[h], self.n).astype(np.int64)
        want = x & np.uint64((1 << self.bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at the indices."""
        ones = np.flatnonzero(np.unpackbits(np.asarray(self.high), bitorder="little"))[: self.n]
        i = np.asarray(i, np.int64)
        return ((ones[i] - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """For each x its index, or -1."""
        x = np.asarray(x, np.uint64)
        i = self.successor(x)
        inside = np.flatnonzero(i < self.n)
        same = np.zeros(len(x), bool)
        # the successor's bucket is x's own unless that bucket has nothing from x on
        h = (x[inside] >> np.uint64(self.bits)).astype(np.int64)
        same[inside] = (i[inside] < self._ends[np.minimum(h, len(self._ends) - 1)]) & (self._low(i[inside]) == x[inside] & np.uint64((1 << self.bits) - 1))
        return np.where(same, i, -1)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high]

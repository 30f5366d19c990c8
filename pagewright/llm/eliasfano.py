"""Elias-Fano sequences over numpy arrays (in memory or memory-mapped), searched many values at a time."""

from __future__ import annotations

import numpy as np

_U = np.uint64
SAMPLE = 32  # every so many zeros, where one stands


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits side by side in 64-bit words, with a spare word."""
    out = np.zeros(len(values) * width // 64 + 2, _U)
    if not width or not len(values):
        return out
    at = np.arange(len(values), dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(_U)
    np.bitwise_or.at(out, word, values << shift)
    over = np.flatnonzero(shift.astype(np.int64) + width > 64)
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (_U(64) - shift[over]))
    return out


class EliasFano:
    """A sequence that never falls: low bits packed, high bits in unary, and samples of where zeros stand among the high bits."""

    PARTS = ("low", "high", "zeros", "ones")

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros, self.ones = n, width, low, high, zeros, ones

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(_U)
        n = len(values)
        width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        top = values >> _U(width)
        size = n + (max(universe - 1, 0) >> width) + 2
        place = top.astype(np.int64) + np.arange(n)
        high = np.zeros(size // 64 + 1, _U)
        np.bitwise_or.at(high, place >> 6, _U(1) << (place & 63).astype(_U))
        empty = np.ones(size, bool)
        empty[place] = False
        zeros = np.flatnonzero(empty)[::SAMPLE].astype(np.int64)
        return EliasFano(n, width, _bits(values & _U((1 << width) - 1), width), high, zeros, place[::SAMPLE].astype(np.int64))

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(_U)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return value & _U((1 << self.width) - 1)

    def _select(self, k: np.ndarray, samples: np.ndarray, flip: int) -> np.ndarray:
        """Where the k-th zero (flip) or one stands."""
        out = samples[k // SAMPLE].copy()
        left = k % SAMPLE
        word = out >> 6
        all_ = _U(0xFFFFFFFFFFFFFFFF)
        bits = (self.high[word] ^ (all_ if flip else _U(0))) & (all_ << (out & 63).astype(_U))
        active = np.arange(len(k))
        while len(active):
            here = np.bitwise_count(bits[active]).astype(np.int64)
            more = here <= left[active]
            move = active[more]
            if not len(move):
                break
            left[move] -= here[more]
            word[move] += 1
            bits[move] = self.high[word[move]] ^ (all_ if flip else _U(0))
            active = move
        # Inside the word: halve the range in which the bit is.
        shift = np.zeros(len(k), _U)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((bits >> shift) & _U((1 << half) - 1)).astype(np.int64)
            go = count <= left
            left -= np.where(go, count, 0)
            shift += np.where(go, _U(half), _U(0))
        return (word << 6) + shift.astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        if not len(i):
            return np.zeros(0, _U)
        top = self._select(i, self.ones, 0) - i
        return (top.astype(_U) << _U(self.width)) | self.lows(i)

    def values(self) -> np.ndarray:
        """All values, in as few bytes as they need; read in one go, which costs far less for each than a search."""
        place = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        out = ((place - np.arange(self.n)).astype(_U) << _U(self.width)) | self.lows(np.arange(self.n))
        return out.astype(np.uint32) if not self.n or out[-1] < _U(1 << 32) else out

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th values and those behind them, with one search for both."""
        if not len(i):
            return np.zeros(0, _U), np.zeros(0, _U)
        place = self._select(i, self.ones, 0)
        word = place >> 6
        rest = (self.high[word] >> (place & 63).astype(_U)) >> _U(1)
        base = place + 1
        active = np.flatnonzero(rest == 0)
        while len(active):
            word[active] += 1
            rest[active] = self.high[word[active]]
            base[active] = word[active] << 6
            active = active[rest[active] == 0]
        after = base + np.bitwise_count((rest & (~rest + _U(1))) - _U(1)).astype(np.int64)
        width = _U(self.width)
        return ((place - i).astype(_U) << width) | self.lows(i), ((after - i - 1).astype(_U) << width) | self.lows(i + 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of the first value that equals x, or -1; a successor search."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        x = x.astype(_U)
        top = (x >> _U(self.width)).astype(np.int64)
        last = int(self.high.size * 64 - 1)
        out = np.full(len(x), -1, np.int64)
        ok = np.flatnonzero(top < last - self.n)
        if not len(ok):
            return out
        t = top[ok]
        zero = self._select(np.maximum(t - 1, 0), self.zeros, 1)
        low = np.where(t > 0, zero - (t - 1), 0)
        # The run of ones that starts behind that zero holds the values of this top; it ends at the next zero.
        start = np.where(t > 0, zero + 1, 0)
        high = low + self._run(start)
        want = x[ok] & _U((1 << self.width) - 1)
        end = high.copy()
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            less = self.lows(middle) < want[active]
            low[active[less]] = middle[less] + 1
            high[active[~less]] = middle[~less]
            active = active[low[active] < high[active]]
        hit = np.flatnonzero(low < end)
        hit = hit[self.lows(low[hit]) == want[hit]]
        out[ok[hit]] = low[hit]
        return out

    def _run(self, at: np.ndarray) -> np.ndarray:
        """Ones from bit ``at`` up to the next zero."""
        count = np.zeros(len(at), np.int64)
        active, place = np.arange(len(at)), at.copy()
        while len(active):
            shift = (place & 63).astype(_U)
            zeros = ~self.high[place >> 6] >> shift
            # Trailing ones of the word: the lowest zero in it.
            lowest = zeros & (~zeros + _U(1))
            ones = np.where(zeros > 0, np.bitwise_count(lowest - _U(1)).astype(np.int64), 64 - shift.astype(np.int64))
            count[active] += ones
            more = zeros == 0
            active = active[more]
            place = ((place[more] >> 6) + 1) << 6
        return count

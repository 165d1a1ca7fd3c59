"""Elias-Fano sequences as arrays: about 2 + log2(universe / n) bits for each value, with look-ups on whole arrays."""

from __future__ import annotations

import numpy as np

#: Widths of the steps to a bit in a word, and masks of their lower bits.
HALVES = tuple((np.uint64(w), np.uint64((1 << w) - 1)) for w in (32, 16, 8, 4, 2, 1))


class EliasFano:
    """A rising sequence of unsigned integers (equal neighbours allowed). `parts` are plain arrays and can be mapped from files.

    The low `bits` bits of each value stand packed one after another. The high parts are one bit string: a one
    for each value, a zero for each step of the high part. `zeros` and `ones` count the zeros and ones before each word of it.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros, self.ones = n, bits, low, high, zeros, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        # low parts
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            low[: int(word[-1]) + 1] += _or_by(word, part << shift, int(word[-1]) + 1)
            over = shift + np.uint64(bits) > np.uint64(64)
            if over.any():
                w = word[over] + 1
                low[: int(w[-1]) + 1] += _or_by(w, part[over] >> (np.uint64(64) - shift[over]), int(w[-1]) + 1)
        # high parts
        steps = (values >> np.uint64(bits)).astype(np.int64) if n else np.zeros(0, np.int64)
        size = n + (int(steps[-1]) if n else 0) + 1
        flags = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
        flags[steps + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        counts = 64 - np.bitwise_count(high).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(counts)])
        kind = np.uint32 if size < 2**31 else np.uint64
        return cls(n, bits, low, high, zeros.astype(kind), (64 * np.arange(len(zeros)) - zeros).astype(kind))

    def arrays(self, name: str = "") -> dict[str, np.ndarray]:
        return {f"{name}n": np.array([self.n, self.bits]), f"{name}low": self.low, f"{name}high": self.high, f"{name}zeros": self.zeros, f"{name}ones": self.ones}

    @classmethod
    def of(cls, x: dict[str, np.ndarray], name: str = "") -> EliasFano:
        """What `arrays` has given, read or mapped."""
        return cls(*map(int, x[f"{name}n"]), *(x[f"{name}{k}"] for k in ("low", "high", "zeros", "ones")))

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero."""
        count = self.ones if ones else self.zeros
        k = k.astype(count.dtype)
        word = np.searchsorted(count, k, "right") - 1
        x = self.high[word]
        if not ones:
            x = ~x
        left = (k - count[word]).astype(np.uint8)
        place = word.astype(np.uint64) << np.uint64(6)
        for width, half in HALVES:  # is it among the lower bits? else take what is above them
            n = np.bitwise_count(x & half)
            above = left >= n
            n *= above
            left -= n
            step = above * width
            x >>= step
            place += step
        return place.astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> shift
        over = shift + np.uint64(self.bits) > np.uint64(64)
        if over.any():
            x[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return x & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        high = self._select(i, ones=True) - i
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value (the first of equal ones), or -1."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = np.asarray(values, np.uint64)
        high = values >> np.uint64(self.bits)
        most = len(self.high) * 64 - 64
        ok = np.flatnonzero(high < np.uint64(max(1, most)))
        h = high[ok].astype(np.int64)
        ok, h = ok[h < int(self.zeros[-1]) - 1], h[h < int(self.zeros[-1]) - 1]
        begin = np.zeros(len(h), np.int64)
        some = h > 0
        begin[some] = self._select(h[some] - 1, ones=False) + 1 - h[some]
        end = self._select(h, ones=False) - h
        want = values[ok] & np.uint64((1 << self.bits) - 1) if self.bits else np.zeros(len(ok), np.uint64)
        live = np.flatnonzero(begin < end)
        lo, hi, want, ok = begin[live], end[live], want[live], ok[live]
        last = hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        inside = np.flatnonzero(lo < last)
        hit = inside[self._low(lo[inside]) == want[inside]]
        out[ok[hit]] = lo[hit]
        return out


def _or_by(word: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Sum of the values for each word; `word` rises."""
    out = np.zeros(size, np.uint64)
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.add.reduceat(value, first)
    return out

"""Elias-Fano coded monotone sequences with vectorised access, on plain buffers that can be memory-mapped."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Place of the r-th set bit of a byte; 8 where there is none.
_SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _r, _p in enumerate([p for p in range(8) if _b >> p & 1]):
        _SELECT[_b, _r] = _p
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit of each rank; before: set bits before each word."""
    at = np.searchsorted(before, rank, side="right") - 1
    word = words[at]
    left = (rank - before[at]).astype(np.int64)
    place = at.astype(np.int64) * 64
    for k in range(8):
        byte = (word >> _U(8 * k) & _U(255)).astype(np.int64)
        ones = _ONES[byte].astype(np.int64)
        here = (left >= 0) & (left < ones)
        place = np.where(here, place + 8 * k + _SELECT[byte, np.clip(left, 0, 7)], place)
        left = np.where(here, -1, np.where(left >= 0, left - ones, left))
    return place


class EliasFano:
    """n values that never fall: low bits packed, high bits in unary.

    Arrays: `head` (n, number of low bits), `low` and `high` as 64-bit words,
    `ones` and `zeros`, the set and unset bits before each word of `high`.
    """

    NAMES = ("head", "low", "high", "ones", "zeros")

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        self.head, self.low, self.high, self.ones, self.zeros = head, low, high, ones, zeros
        self.n, self.bits = int(head[0]), int(head[1])

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """From sorted uint64 values."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & _U((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * _U(bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + _U(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        place = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        size = (int(place[-1]) + 2 if n else 1) // 64 + 1
        plain = np.zeros(size * 64, np.uint8)
        plain[place] = 1
        high = np.packbits(plain, bitorder="little").view(np.uint64)
        per = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(per)[:-1]])
        return cls(np.array([n, bits], np.int64), low, high, ones, np.arange(size) * 64 - ones)

    def parts(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.NAMES}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        value = self.low[word] >> shift
        over = shift + _U(self.bits) > 64
        value[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
        return value & _U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, np.int64)
        return ((_select(self.high, self.ones, i) - i).astype(np.uint64) << _U(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value >= x among places first..last-1 (of all by default), last if there is none; and whether it equals x."""
        x = np.asarray(x, np.uint64)
        bucket = (x >> _U(self.bits)).astype(np.int64)
        begin = np.zeros(len(x), np.int64) if first is None else first.astype(np.int64)
        stop = np.full(len(x), self.n, np.int64) if last is None else last.astype(np.int64)
        if not self.n:
            return begin, np.zeros(len(x), bool)
        zeros = int(len(self.high) * 64 - self.n)
        inside = bucket < zeros
        b = np.minimum(bucket, zeros - 1)
        # values of the bucket stand between its zero and the zero before it
        down = ~self.high
        end = np.where(inside, _select(down, self.zeros, b) - b, self.n)
        start = np.where(bucket > 0, np.where(inside, _select(down, self.zeros, np.maximum(b - 1, 0)) - (b - 1), self.n), 0)
        lo, hi = np.clip(start, begin, stop), np.clip(end, begin, stop)
        want = x & _U((1 << self.bits) - 1)
        to = hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        found = np.zeros(len(x), bool)
        some = np.flatnonzero((lo < to) & inside)
        found[some] = self._low(lo[some]) == want[some]
        return lo, found

"""Vectorised 64-bit identities of words and word shingles.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased.  A word's
identity is a polynomial over a table of random numbers, one for each byte
value, modulo 2**64, then mixed with the word's length; equality of words and of
shingles is decided on these 64 bits.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = int(_rng.integers(1, 1 << 62, dtype=np.uint64)) * 4 + 1
_BACK = pow(_STEP, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed in one step.
BLOCK = 1 << 19
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))]) for base in (_STEP, _BACK)]
    return _powers[0][:n], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with good avalanche."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and identities of the words of `data`, which begins and ends at a word's boundary."""
    gap = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    power, back = _power(len(data))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power)])
        return start, mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _PLACE[7])


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Identities of the words of all texts in order, and for each text the index of its first (one more at the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    starts, ids, at = [], [], 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        while to < len(data) and not _SPACE[data[to]]:
            stop = np.flatnonzero(_SPACE[data[to : to + 4096]])
            to = to + int(stop[0]) if len(stop) else min(to + 4096, len(data))
        s, h = _block(data[at:to])
        starts.append(s + at)
        ids.append(h)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(ids) if ids else np.zeros(0, np.uint64)), np.searchsorted(start, first)


def combine(ids: list[np.ndarray]) -> np.ndarray:
    """Identity of a sequence of words from theirs."""
    with np.errstate(over="ignore"):
        out = np.full_like(ids[0], len(ids) * 0x9E3779B1)
        for k, x in enumerate(ids):
            out = out + x * _PLACE[k]
        return mix(out)


def shingles(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Identities of all shingles of `size` words, not yet distinct, and the first index of each text (one more at the end).

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    ids, first = words(texts)
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.zeros(int(n.sum()), np.uint64)
    begin = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    if len(ids) >= size:
        rolled = combine([ids[k : len(ids) - size + 1 + k] for k in range(size)])
        long = count >= size
        where = np.repeat(first[:-1][long] - begin[:-1][long], n[long]) + _ranges(begin[:-1][long], n[long])
        out[_ranges(begin[:-1][long], n[long])] = rolled[where]
    for i in np.flatnonzero((count < size) & (count > 0)):
        out[begin[i]] = combine([ids[first[i] + k : first[i] + k + 1] for k in range(count[i])])[0]
    return out, begin


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] numbers, then start[1] ..."""
    if not len(n):
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    return np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(start, n)

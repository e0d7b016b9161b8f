"""Periodic runs of words by the runs theorem.

A run is a stretch of words with a smallest period q that no neighbouring word
extends.  The theorem: the Lyndon root of every run is, under one of the two
orders of the alphabet, the longest Lyndon word at its place.  So:

* suffixes are sorted under both orders (prefix doubling, in which only groups
  that are not yet told apart are sorted again);
* the longest Lyndon word at i ends before the next smaller value of the
  inverse suffix array;
* a root of length p at i is extended to the right by the longest common
  prefix of the suffixes i and i + p, a range minimum of the LCP array, from a
  sparse table that is built and asked level by level, so that it never holds
  more than one level.

A run of at least four periods has a root in its first period whose extension
to the right is longer than two periods; only such roots are taken, and their
extension to the left is shorter than a period and compared word by word, which
is at most the run's own length for all its roots.

Texts are handled by Spark tasks in slices; within a slice all texts are sorted
at once, each among its own suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Words that the LCP array is compared for at once; longer ones are found one by one, in order of text.
_AHEAD = 24
#: Elements whose next smaller value is searched by jumps of whole arrays; fewer are searched one by one.
_FEW = 256


def suffix_ranks(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of all suffixes; suffix i ends before ends[i], which is smaller than any word.

    Suffixes of later texts are smaller, so that no value of a text is
    followed by a smaller one of its own beyond its end.
    """
    n = len(ids)
    key = (n - ends) * (int(ids.max(initial=0)) + 1) + ids
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    slots, members, keys = np.arange(n), sa, key[sa]
    sa = sa.copy()
    h = 0
    while True:
        fresh = np.ones(len(slots), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(slots)))
        rank[members] = np.repeat(slots[begin], size)
        sa[slots] = members
        several = np.repeat(size > 1, size)
        slots, members = slots[several], members[several]
        if not len(slots):
            return sa, rank
        h = 2 * h if h else 1
        after = members + h
        second = np.where(after < ends[members], rank[np.minimum(after, n - 1)] + 1, 0)
        keys = rank[members] * (n + 1) + second
        order = np.argsort(keys, kind="stable")
        members, keys = members[order], keys[order]


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one of smaller rank, or the length."""
    n = len(rank)
    value = np.append(rank, -1)
    to = np.arange(1, n + 1)
    todo = np.flatnonzero(value[to] > rank)
    while len(todo) > _FEW:
        # all between to[i] and to[to[i]] is greater than to[i]'s value, which is greater than i's
        to[todo] = to[to[todo]]
        todo = todo[value[to[todo]] > rank[todo]]
    if len(todo):
        values, jump = value.tolist(), to.tolist()
        for i in todo[::-1].tolist():
            own, k = values[i], jump[i]
            while values[k] > own:
                k = jump[k]
            jump[i] = k
        to = np.array(jump)
    return to


def common_prefixes(ids: np.ndarray, ends: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[k]: words that the suffixes sa[k - 1] and sa[k] have in common, 0 between texts."""
    n = len(ids)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    own = np.zeros(n, np.int64)
    open_ = np.flatnonzero((before >= 0) & (ends[before] == ends))
    room = np.minimum(ends[open_] - open_, ends[open_] - before[open_])
    for k in range(_AHEAD):
        go = room > k
        go[go] = ids[open_[go] + k] == ids[before[open_[go]] + k]
        open_, room = open_[go], room[go]
        if not len(open_):
            break
        own[open_] = k + 1
    if len(open_):
        word, found, last, held = ids.tolist(), 0, -2, own.tolist()
        for i, j, most in zip(open_.tolist(), before[open_].tolist(), room.tolist(), strict=True):
            k = max(_AHEAD, (found if last == i - 1 else held[i - 1] if i else 0) - 1)
            while k < most and word[i + k] == word[j + k]:
                k += 1
            held[i] = found = k
            last = i
        own = np.array(held)
    return own[sa]


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low[k]..high[k]]), ends included: a sparse table of which one level is held at a time."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp(high - low + 1)[1] - 1
    order = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
    for k in range(len(bounds) - 1):
        some = order[bounds[k] : bounds[k + 1]]
        out[some] = np.minimum(values[low[some]], values[high[some] - (1 << k) + 1])
        values = np.minimum(values[: -(1 << k)], values[1 << k :]) if len(values) > 1 << k else values[:0]
    return out


def runs(ids: np.ndarray, first: np.ndarray, min_length: int = 6, min_periods: int = 4) -> np.ndarray:
    """Rows (text, start, length, period), sorted, of the runs of at least `min_length` words and `min_periods` (3 or more) periods.

    Text t is ids[first[t] : first[t + 1]]; ids are numbers from 0.
    """
    n = len(ids)
    found = []
    ends = np.repeat(first[1:], np.diff(first))
    if n:
        sa, rank = suffix_ranks(ids, ends)
        lcp = common_prefixes(ids, ends, sa, rank)
        for order in (0, 1):
            i = np.arange(n)
            j = next_smaller(rank if not order else suffix_ranks(int(ids.max()) - ids, ends)[1])
            near = j < ends
            i, j = i[near], j[near]
            same = ids[i] == ids[j]
            i, j = i[same], j[same]
            low, high = np.minimum(rank[i], rank[j]), np.maximum(rank[i], rank[j])
            right = range_minima(lcp, low + 1, high)
            wide = right > (min_periods - 2) * (j - i)
            found += [(a, b - a, r) for a, b, r in zip(i[wide].tolist(), j[wide].tolist(), right[wide].tolist(), strict=True)]
    text = np.searchsorted(first, [a for a, _, _ in found], side="right") - 1
    out = set()
    for t, (a, p, r) in zip(text.tolist(), found, strict=True):
        back = min(p, a - int(first[t]))
        unlike = np.flatnonzero(ids[a - back : a] != ids[a - back + p : a + p])
        left = back - 1 - int(unlike[-1]) if len(unlike) else back
        length = left + p + r
        if left < p and length >= max(min_length, min_periods * p):
            out.add((t, a - left - int(first[t]), length, p))
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def _collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if not len(found):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, found[:, 1] + found[:, 3], 1)
    np.add.at(step, found[:, 1] + found[:, 2], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)])


def _runs_of(text: str, min_length: int, min_periods: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = [(t or "").encode("utf-8").split() for t in batch.column(text).to_pylist()]
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        every = np.empty(int(first[-1]), object)
        every[:] = [x for w in words for x in w]
        found = runs(pd.factorize(every)[0].astype(np.int64), first, min_length, min_periods)
        at = np.searchsorted(found[:, 0], np.arange(len(words) + 1))
        fields = [pa.array(found[:, k]) for k in (1, 2, 3)]
        listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
        short = [_collapsed(w, found[a:b]).decode("utf-8") for w, a, b in zip(words, at[:-1], at[1:], strict=True)]
        kept = [n for n in batch.schema.names if n != text]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(np.diff(first)), listed, pa.array(short, pa.string())], names=[*kept, "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text: str = "text", *, min_length: int = 6, min_periods: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (*keep, n_words, runs, collapsed), one for each row of `docs`.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0; upper
    and lower case differ.  `runs` are structs (start, length, period) of the
    stretches that have at least `min_length` words and `min_periods` (3 or
    more) times their smallest period and that no neighbouring word extends,
    by start, then period.  `collapsed` are the words that no run contains
    after its first period, joined by one space.  A null or blank text has no
    words, no runs and an empty `collapsed`.  Ids may be null, repeated or of
    any type; every row counts by itself; other columns are ignored; texts of
    any length are handled whole, in memory that follows their words.  An
    empty table gives no rows.
    """
    if min_periods < 3:
        raise ValueError("min_periods is 3 or more")
    named = {f"_keep{k}": c for k, c in enumerate(keep)}
    source = docs.select(*(F.col(c).alias(n) for n, c in named.items()), F.col(text).alias("text"))
    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in named.items())
    out = map_arrow(source, _runs_of("text", min_length, min_periods), f"{kinds}n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", "text")
    return out.select(*(F.col(n).alias(c) for n, c in named.items()), "n_words", "runs", "collapsed")

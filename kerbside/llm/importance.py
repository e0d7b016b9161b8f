"""Importance resampling towards a target by hashed word n-grams.

In each task texts are handled in slices.  The words of a slice become ids, and
the suffixes of the slice are sorted by their first three ids (a word-id suffix
array of the depth that features have).  Neighbours that have k ids in common
are one n-gram of k words: such a run is hashed once, the hash of its first
k - 1 words carried on, and the bucket is scattered back to all places of the
run.  Places are then counted by bucket (first pass, over the raw and the
target texts) or summed up by text with the gains of their buckets (second
pass).  No text, n-gram or place is shuffled: the first pass gives at most one
count for each bucket and task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, slices

#: Words of a feature at most.
DEPTH = 3
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of text whose suffixes are sorted at once.
SLICE_BYTES = 1 << 22


def words(texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids of the words of all texts, the word of each id, and the index of each text's first (one more at the end)."""
    found = [_WORD.findall((t or "").encode("utf-8").translate(_LOWER)) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    every = np.empty(int(first[-1]), object)
    every[:] = [w for f in found for w in f]
    ids, known = pd.factorize(every)
    return ids.astype(np.int64), list(known), first


def suffixes(ids: np.ndarray, first: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `depth` words, and how many of them each has in common with the one before.

    A text's end is smaller than any word and equal to nothing.
    """
    n = len(ids)
    ends = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    columns = [np.where(at + k < ends, ids[np.minimum(at + k, n - 1)] + 1, 0) for k in range(depth)]
    width = int(ids.max(initial=0)) + 2
    if width**depth < 1 << 62:
        key = columns[0]
        for c in columns[1:]:
            key = key * width + c
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(columns[::-1])
    common = np.zeros(n, np.int64)
    go = np.ones(n, bool)
    go[:1] = False
    for c in columns:
        c = c[order]
        go[1:] &= (c[1:] == c[:-1]) & (c[1:] > 0)
        common += go
    return order, common


def buckets(ids: np.ndarray, known: list[bytes], first: np.ndarray, size: int, depth: int = DEPTH) -> list[np.ndarray]:
    """For each k from 1 to `depth` the bucket of the k words from each place, -1 where the text has fewer."""
    n = len(ids)
    order, common = suffixes(ids, first, depth)
    ends = np.repeat(first[1:], np.diff(first))
    spaced = [b" " + w for w in known]
    hashes = np.zeros(n, np.int64)  # of the k words from each suffix, in sorted order
    out = []
    for k in range(1, depth + 1):
        fits = order + k <= ends[order]
        begins = np.flatnonzero(fits & (common < k))
        last = ids[order[begins] + k - 1].tolist()
        if k == 1:
            fresh = [zlib.crc32(known[w]) for w in last]
        else:
            fresh = [zlib.crc32(spaced[w], h) for w, h in zip(last, hashes[begins].tolist(), strict=True)]
        # the places of a run follow its first one, none that doesn't fit among them
        run = np.cumsum(np.bincount(begins, minlength=n))[:n] - 1
        hashes = np.where(fits, np.array(fresh or [0], np.int64)[np.maximum(run, 0)], hashes)
        place = np.full(n, -1)
        place[order] = np.where(fits, hashes % size, -1)
        out.append(place)
    return out


def _counted(text: str, size: int):
    """Rows (bucket, n): what the texts of a task hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for some in slices(batch, text, SLICE_BYTES):
                for place in buckets(*words(some.column(text).to_pylist()), size):
                    total += np.bincount(place[place >= 0], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return run


def _weighed(text: str, gains: np.ndarray):
    """Each row with the number of its text's words and features and the sum of their gains."""
    padded = np.append(gains, 0)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, known, first = words(batch.column(text).to_pylist())
        n = np.diff(first)
        weight = np.zeros(len(n), np.int64)
        for place in buckets(ids, known, first, len(gains)):
            total = np.concatenate([[0], np.cumsum(padded[place])])
            weight += total[first[1:]] - total[first[:-1]]
        kept = [c for c in batch.schema.names if c != text]
        features = sum(np.maximum(n - k, 0) for k in range(DEPTH))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n), pa.array(features), pa.array(weight)], names=[*kept, "n_words", "n_features", "weight"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text", *, size: int = 10_000) -> DataFrame:
    """Rows (bucket, n): features of all texts by bucket; buckets without any are missing."""
    return texts.select(F.col(text).alias("text")).mapInArrow(_counted("text", size), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(raw: DataFrame, target: DataFrame, text: str = "text", *, size: int = 10_000) -> np.ndarray:
    """What a feature of each bucket adds to a weight: floor(1000 ln) of the target's share over the raw share, both counts with one added.  `size` numbers reach the driver."""
    both = bucket_counts(raw, text, size=size).withColumn("side", F.lit(0)).unionByName(bucket_counts(target, text, size=size).withColumn("side", F.lit(1)))
    counts = np.zeros((2, size), np.float64)
    for r in both.collect():
        counts[r.side, r.bucket] = r.n
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def noise(id_col: str, seed: int = 42) -> F.Column:
    """floor(1000 x a Gumbel number) of a row's id; a null id counts as the text `null`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[F.Column], percent: int) -> DataFrame:
    """`rows` with `rank`: 1, 2, 3 ... in `order` for the first floor(percent n / 100) of n, else null.

    The sorted rows are written with their place in their task; a row's rank is
    that place and the number of rows in earlier tasks, one number a task.
    """
    placed = materialize(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_task", F.shiftright("_at", 33))
    counts = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).collect()
    before, total = {}, 0
    for task, n in sorted((r[0], r[1]) for r in counts):
        before[task], total = total, total + n
    earlier = rows.sparkSession.createDataFrame(list(before.items()), "_task long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    out = placed.join(F.broadcast(earlier), "_task").withColumn("rank", F.when(rank <= percent * total // 100, rank))
    return out.drop("_at", "_task", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", *, percent: int = 5, min_words: int = 20, size: int = 10_000, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, *keep, n_words, n_features, weight, score, rank), one for each row of `docs`.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the whole text, A-Z
    lower-cased; features are all runs of one to three consecutive words,
    repeats counted, hashed to `size` buckets by crc32.  weight sums the
    buckets' gains (see gains_of), score adds Gumbel noise of the id, so that
    the `percent` hundredths of best score, of the rows with `min_words` words
    or more, are a sample without replacement that follows the target.  rank is
    the place in that sample, ties to the smaller id (null ids last), null if
    the row is not drawn.  A null or blank text has no features and weight 0.
    Rows without an id share one noise; rows equal in id and score are ranked
    in any order.  Other columns are ignored; texts of any length are handled
    whole.  An empty table gives no rows, an empty target gives gains of the
    raw counts alone.
    """
    named = {f"_keep{k}": c for k, c in enumerate(keep)}
    source = docs.select(F.col(id_col).alias("_id"), *(F.col(c).alias(n) for n, c in named.items()), F.col(text).alias("text"))
    kinds = "".join(f"{n} {source.schema[n].dataType.simpleString()}, " for n in ("_id", *named))
    gains = gains_of(docs, target, text, size=size)
    weighed = map_arrow(source, _weighed("text", gains), f"{kinds}n_words long, n_features long, weight long", "text", SLICE_BYTES)
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise("_id", seed)), "scored")
    enough = F.col("n_words") >= min_words
    drawn = ranked(scored.where(enough), [F.desc("score"), F.asc_nulls_last("_id")], percent)
    out = drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("_id").alias(id_col), *(F.col(n).alias(c) for n, c in named.items()), "n_words", "n_features", "weight", "score", "rank")

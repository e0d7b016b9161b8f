"""Detection and tracking quality against ground truth.

Ground truth has frame, track_id and a box x1..y2; predictions have frame,
tracked_id, confidence and a box.  `by` names the clip; frames are matched in
their own tasks.
"""

from __future__ import annotations

from itertools import permutations
from math import perm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from .assignment import assign
from .graph import cut
from .sequences import whole_groups
from .sparse_assignment import most_weight

BOX = ("x1", "y1", "x2", "y2")
#: Ways to match a frame's boxes that are all tried.
WAYS = 24


def overlaps(truth: DataFrame, found: DataFrame, threshold: float, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Pairs of one frame whose boxes overlap enough: all columns of both (those of `found` with p_ before) and iou."""
    p = found.select(*(F.col(c) if c in by else F.col(c).alias(f"p_{c}") for c in found.columns))
    pairs = truth.join(p, list(by)).withColumn("iou", iou(tuple(F.col(c) for c in BOX), tuple(F.col(f"p_{c}") for c in BOX)))
    return pairs.where(F.col("iou") >= threshold)


def _iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of boxes [..., n, 4] with boxes [..., m, 4]."""
    a, b = a[..., :, None, :], b[..., None, :, :]
    w = np.clip(np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]), 0, None)
    h = np.clip(np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]), 0, None)
    both = w * h
    union = (a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1]) + (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1]) - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def _frames(truth: DataFrame, found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    t = truth.select(*by, F.lit(0).alias("side"), F.col("track_id").cast("long").alias("id"), F.lit(0.0).alias("confidence"), *(F.col(c).cast("double").alias(c) for c in BOX))
    p = found.select(*by, F.lit(1).alias("side"), F.col("tracked_id").cast("long").alias("id"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), *(F.col(c).cast("double").alias(c) for c in BOX))
    return t.unionByName(p)


def _by_frame(truth: DataFrame, found: DataFrame, by: tuple[str, ...], match, columns: str) -> DataFrame:
    """Applies `match` to the boxes of frames, those with as many true and found boxes at once.

    match(true boxes [frames, n, 4], found boxes [frames, m, 4], confidence [frames, m], true rows [frames, n],
    found rows [frames, m]) gives a row of each result, and its columns as functions of the table.
    """
    rows = _frames(truth, found, by)
    kinds = ", ".join(f"{c} {truth.schema[c].dataType.simpleString()}" for c in by)

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        sizes = np.diff([*starts, len(table)])
        true = np.add.reduceat(table["side"].to_numpy() == 0, starts, dtype=np.int64)
        boxes, confidence = np.column_stack([table[c].to_numpy() for c in BOX]), table["confidence"].to_numpy()
        shape, of = np.unique(np.column_stack([true, sizes - true]), axis=0, return_inverse=True)
        parts = []
        for k, (n, m) in enumerate(shape.tolist()):
            first = starts[of.ravel() == k][:, None]
            t, p = first + np.arange(n), first + n + np.arange(m)
            parts.append(match(boxes[t], boxes[p], confidence[p], t, p))
        at, *cells = (np.concatenate(c) for c in zip(*parts, strict=True))
        out = table.select(list(by)).take(pa.array(at))
        for (name, kind), values in zip((c.split() for c in columns.split(", ")), cells, strict=True):
            # numbers of rows stand for the ids in them, -1 for none
            out = out.append_column(name, table["id"].take(pa.array(values, mask=values < 0)) if kind == "long" else pa.array(values))
        return out

    return whole_groups(rows, list(by), ["side", "id", *BOX], run, f"{kinds}, {columns}")


def greedy_matches(truth: DataFrame, found: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Rows (by, confidence, tp) for each prediction: the most confident first takes the best box that is free."""

    def match(t_boxes, p_boxes, confidence, t, p):
        over, frame = _iou_matrix(p_boxes, t_boxes), np.arange(len(t))
        free, hits = np.ones(t.shape, bool), np.zeros(p.shape, bool)
        order = np.argsort(-confidence, axis=1, kind="stable")
        for k in range(p.shape[1] if t.shape[1] else 0):
            o = np.where(free, over[frame, order[:, k]], -1.0)
            j = np.argmax(o, axis=1)
            hit = o[frame, j] >= threshold
            free[frame[hit], j[hit]] = False
            hits[:, k] = hit
        return p.ravel(), np.take_along_axis(confidence, order, axis=1).ravel(), hits.ravel()

    return _by_frame(truth, found, by, match, "confidence double, tp boolean")


def precision_recall(matches: DataFrame, truths: int, order: list | None = None, count: str | None = None) -> DataFrame:
    """Rows (confidence, tp, recall, precision): running sums from the most confident prediction down; `count`, if given, holds how many predictions a row stands for.

    Ranges of confidence are summed on their own and added up, so that no task
    sees all predictions.
    """
    order = order or [F.col("confidence").desc(), F.col("tp").desc()]
    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = matches.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    each = F.col(count) if count else F.lit(1).cast("long")
    local = ranged.withColumn("_tp", F.sum(F.col("tp").cast("long") * each).over(w)).withColumn("_n", F.sum(each).over(w))
    sums = local.groupBy("_part").agg(F.max("_tp").alias("t"), F.max("_n").alias("n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = sums.select("_part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("_t0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n0"))
    tp, n = F.col("_tp") + F.col("_t0"), F.col("_n") + F.col("_n0")
    return local.join(F.broadcast(before), "_part").select("confidence", "tp", (tp / F.lit(float(max(truths, 1)))).alias("recall"), (tp / n).alias("precision"))


def average_precision(curve: DataFrame) -> DataFrame:
    """One row (ap): the mean over recalls 0, 0.01 ... 1 of the best precision at that recall or more."""
    step = F.least(F.lit(100), F.floor(F.round(F.col("recall") * 100.0, 9))).cast("int")
    best = curve.groupBy(step.alias("at")).agg(F.max("precision").alias("p"))  # at most 101 rows
    every = curve.sparkSession.range(101).select(F.col("id").cast("int").alias("t"))
    reached = every.join(F.broadcast(best), F.col("at") >= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("p"))
    return reached.agg(F.avg("p").alias("ap"))


def scores(tp: int, predicted: int, truths: int) -> dict[str, float]:
    """Precision, recall and F1; 0 where undefined."""
    p, r = tp / predicted if predicted else 0.0, tp / truths if truths else 0.0
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}


def detection_metrics(truth: DataFrame, found: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ("frame",)) -> dict[str, float]:
    """AP, precision, recall, F1 over the frames that have ground truth."""
    own = found.join(truth.select(*by).distinct(), list(by), "left_semi")
    # hits raise the precision and others lower it, so of equal confidence the last hit counts alone, and numbers do for rows
    matches = cut(greedy_matches(truth, own, threshold, by).groupBy("confidence", "tp").agg(F.count(F.lit(1)).alias("n")))
    n = truth.count()
    row = matches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("p"), F.coalesce(F.sum(F.col("n") * F.col("tp").cast("long")), F.lit(0)).alias("t")).first()
    return scores(row.t, row.p, n) | {"ap": average_precision(precision_recall(matches, n, count="n")).first().ap, "n_truth": n, "n_found": row.p}


def frame_matches(truth: DataFrame, found: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Rows (by, track_id, tracked_id) for each true box: the assignment of most overlap in its frame, null where that is below the threshold."""

    def match(t_boxes, p_boxes, confidence, t, p):
        over = _iou_matrix(t_boxes, p_boxes)
        frames, n, m = over.shape
        if not (n and m):
            return t.ravel(), t.ravel(), np.full(t.size, -1)
        best, pick = over.max(axis=2), over.argmax(axis=2)
        some, alone = best > 0, (over == best[:, :, None]).sum(axis=2) == 1
        shared = (pick[:, :, None] == pick[:, None, :]) & some[:, :, None] & some[:, None, :] & ~np.eye(n, dtype=bool)
        # where each box has a best of its own there is no other assignment; of those with few ways all are tried
        hard = np.flatnonzero((some & ~alone).any(axis=1) | shared.any(axis=(1, 2)))
        if len(hard) and perm(max(n, m), min(n, m)) <= WAYS:
            ways = np.array(list(permutations(range(max(n, m)), min(n, m))))
            few = over[hard] if n <= m else over[hard].transpose(0, 2, 1)
            chosen = ways[few[:, np.arange(min(n, m)), ways].sum(axis=2).argmax(axis=1)]
            if n <= m:
                pick[hard] = chosen
            else:
                pick[hard] = -1
                pick[hard[:, None], chosen] = np.arange(m)
        else:
            for f in hard:
                pick[f] = -1
                for i, j in assign(-over[f]):
                    pick[f, i] = j
        good = (pick >= 0) & (np.take_along_axis(over, pick[:, :, None].clip(0), axis=2)[:, :, 0] >= threshold)
        return t.ravel(), t.ravel(), np.where(good, np.take_along_axis(p, pick.clip(0), axis=1), -1).ravel()

    return _by_frame(truth, found, by, match, "track_id long, tracked_id long")


def switches(matches: DataFrame, clip: tuple[str, ...] = (), frame: str = "frame") -> DataFrame:
    """Rows (clip, switches): a true track that is matched now and had another state (another id, or none) the last time it was seen.

    From none to an id counts, from an id to none does not.
    """
    w = Window.partitionBy(*clip, "track_id").orderBy(frame)
    before = F.lag(F.struct("tracked_id")).over(w)
    return matches.withColumn("_b", before).groupBy(*clip).agg(F.count_if(_switched()).alias("switches"))


def _switched() -> Column:
    """Whether a row's tracked_id differs from that in _b, the state before."""
    return F.col("tracked_id").isNotNull() & F.col("_b").isNotNull() & ~F.col("_b.tracked_id").eqNullSafe(F.col("tracked_id"))


def track_hits(matches: DataFrame, clip: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each clip): true tracks, those hit in 80 % of their frames or more, and in less than 20 %."""
    per = matches.groupBy(*clip, "track_id").agg(F.avg(F.col("tracked_id").isNotNull().cast("double")).alias("share"))
    return _hit_counts(per, clip)


def _hit_counts(shares: DataFrame, clip: tuple[str, ...]) -> DataFrame:
    return shares.groupBy(*clip).agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("share") >= 0.8).alias("mostly_tracked"), F.count_if(F.col("share") < 0.2).alias("mostly_lost"))


def identity_counts(matches: DataFrame) -> DataFrame:
    """Frames in which a true track has been matched with a predicted one."""
    return matches.where("tracked_id is not null").groupBy("track_id", "tracked_id").agg(F.count(F.lit(1)).alias("n"))


def identity_f1(matches: DataFrame, truths: int, predicted: int) -> float:
    """IDF1 by the assignment of tracks with most matched frames, see `sparse_assignment`."""
    counts = identity_counts(matches).select(F.col("track_id").alias("a"), F.col("tracked_id").alias("b"), F.col("n").alias("w"))
    return _idf1(most_weight(counts), truths, predicted)


def _idf1(best: DataFrame, truths: int, predicted: int) -> float:
    hit = best.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    return 2 * hit / (truths + predicted) if truths + predicted else 0.0


def tracking_metrics(truth: DataFrame, found: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ("frame",)) -> dict[str, float]:
    """MOTA, IDF1, switches, FP, FN, mostly tracked and lost, over the frames that have ground truth."""
    own = found.join(truth.select(*by).distinct(), list(by), "left_semi")
    seen = frame_matches(truth, own, threshold, by).withColumn("_b", F.lag(F.struct("tracked_id")).over(Window.partitionBy("track_id").orderBy("frame")))
    # one pass over the boxes: all that is told comes from numbers of each pair of tracks
    pairs = cut(seen.groupBy("track_id", "tracked_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(_switched()).alias("switches")))
    hit = F.coalesce(F.sum(F.when(F.col("tracked_id").isNotNull(), F.col("n"))), F.lit(0))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), hit.alias("hit"), F.coalesce(F.sum("switches"), F.lit(0)).alias("sw")).first()
    hits = _hit_counts(pairs.groupBy("track_id").agg((hit / F.sum("n")).alias("share")), ()).first()
    n, p, sw = total.n, own.count(), total.sw
    fp, fn = p - total.hit, n - total.hit
    best = most_weight(pairs.where("tracked_id is not null").select(F.col("track_id").alias("a"), F.col("tracked_id").alias("b"), F.col("n").alias("w")))
    return {"mota": 1 - (fp + fn + sw) / n if n else 0.0, "idf1": _idf1(best, n, p), "switches": sw, "fp": fp, "fn": fn, "mostly_tracked": hits.mostly_tracked, "mostly_lost": hits.mostly_lost, "tracks": hits.tracks, "n_truth": n, "n_found": p}

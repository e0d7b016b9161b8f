"""Tracking by overlap in pieces of a camera's frames: `tracking.track_by_overlap` says what it gives.

Only boxes of a few frames that overlap enough can be of one track.  Where no
such pair reaches over a frame's beginning, what comes before has no say in what
comes behind, so a camera is cut there (once in each stretch of frames) and the
pieces are tracked apart.  Ids are counted on from piece to piece by sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .long_tracks import joined
from .sequences import deal, whole_groups

BOX = ("x1", "y1", "x2", "y2")
#: Frames of a stretch, the first of them in which a cut is looked for, rows that a call takes at least, and stretches that are broadcast.
STRETCH, HEAD, AT_ONCE, FEW = 20_000, 4_000, 200_000, 1_000_000


def _arrays(part: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, frame and box of each row."""
    new = np.zeros(len(part), np.int64)
    new[starts] = 1
    return np.cumsum(new) - 1, part["frame"].to_numpy().astype(np.int64), np.column_stack([part[c].to_numpy(zero_copy_only=False).astype(float) for c in BOX])


def pairs(group: np.ndarray, frame: np.ndarray, box: np.ndarray, threshold: float, max_age: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, overlap) of rows of a group, b at most `max_age` frames behind a, that overlap enough; rows lie by group, frame."""
    n, found = len(frame), []
    at = np.arange(n - 1) if n else np.zeros(0, int)
    area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    for k in range(1, n):
        at = at[: np.searchsorted(at, n - k)]
        at = at[(group[at + k] == group[at]) & (frame[at + k] - frame[at] <= max_age)]
        if not len(at):
            break
        a = at[frame[at + k] > frame[at]]
        w = np.clip(np.minimum(box[a, 2], box[a + k, 2]) - np.maximum(box[a, 0], box[a + k, 0]), 0, None)
        if threshold > 0:
            a, w = a[w > 0], w[w > 0]
        h = np.clip(np.minimum(box[a, 3], box[a + k, 3]) - np.maximum(box[a, 1], box[a + k, 1]), 0, None)
        both = w * h
        union = area[a] + area[a + k] - both
        over = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        some = over >= threshold
        found.append((a[some], a[some] + k, over[some]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((int, int, float)))


def follow(frame_number: np.ndarray, a: np.ndarray, b: np.ndarray, over: np.ndarray) -> np.ndarray:
    """The row before each row on its track, -1 for the first: frame after frame the best pairs of rows that end a track and of the frame's rows."""
    n = len(frame_number)
    before, after = np.full(n, -1), np.full(n, -1)
    # a pair that has no rival
    alone = (np.bincount(a, minlength=n)[a] == 1) & (np.bincount(b, minlength=n)[b] == 1)
    before[b[alone]], after[a[alone]] = a[alone], b[alone]
    a, b, over = a[~alone], b[~alone], over[~alone]
    order = np.lexsort((b, -over, frame_number[b]))
    a, b, over = a[order], b[order], over[order]
    ends = np.flatnonzero(np.diff(frame_number[b])) + 1

    def born(i: int) -> int:
        while before[i] >= 0:
            i = before[i]
        return int(i)

    for some in np.split(np.arange(len(a)), ends) if len(a) else []:
        # of equal overlaps the oldest track's counts
        for _, _, j, i in sorted((-over[k], born(a[k]), b[k], a[k]) for k in some if after[a[k]] < 0):
            if before[j] < 0 and after[i] < 0:
                before[j], after[i] = i, j
    return before


def _frames(group: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """The number of the frame that each row is in."""
    return np.cumsum(np.concatenate([[0], (np.diff(group) != 0) | (np.diff(frame) != 0)]))


def cuts(rows: DataFrame, by: str, threshold: float, max_age: int, stretch: int, head: int) -> DataFrame:
    """Rows (by, _chunk, cut): a frame among the first of a stretch over whose beginning no pair reaches."""
    at = F.col("frame") - F.col("_chunk") * stretch
    kept = [by, "_chunk", "frame", *BOX]
    own = rows.where(at < head).select(*kept, F.lit(True).alias("_own"))
    # a pair reaches back into the stretch before by max_age frames at most
    lead = rows.where(at >= stretch - max_age).withColumn("_chunk", F.col("_chunk") + 1).select(*kept, F.lit(False).alias("_own"))

    def run(part: pa.Table, starts: np.ndarray) -> pa.Table:
        group, frame, box = _arrays(part, starts)
        a, b, _ = pairs(group, frame, box, threshold, max_age)
        number = _frames(group, frame)
        over = np.zeros(number[-1] + 2, np.int64)
        np.add.at(over, number[a] + 1, 1)
        np.add.at(over, number[b] + 1, -1)
        free = (np.cumsum(over)[number] == 0) & part["_own"].to_numpy(zero_copy_only=False) & (frame - part["_chunk"].to_numpy() * stretch <= head - max_age)
        free = np.flatnonzero(free)
        first = free[np.concatenate([[True], np.diff(group[free]) != 0])] if len(free) else free
        out = part.select([by, "_chunk"]).take(pa.array(first))
        return out.append_column("cut", pa.array(frame[first]))

    return whole_groups(own.unionByName(lead), [by, "_chunk"], ["frame"], run, f"`{by}` {rows.schema[by].dataType.simpleString()}, _chunk long, cut long", AT_ONCE)


def _small(df: DataFrame) -> DataFrame:
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW else df


def track(rows: DataFrame, threshold: float, max_age: int, by: str, stretch: int = STRETCH, head: int = HEAD) -> DataFrame:
    """`rows` with track_id, see `tracking.track_by_overlap`."""
    stretch = max(stretch, 4 * max_age)
    head = min(max(head, 2 * max_age), stretch)
    kind = rows.schema[by].dataType.simpleString()
    parted = rows.withColumn("_chunk", F.floor(F.col("frame") / stretch).cast("long"))
    found = cuts(parted, by, threshold, max_age, stretch, head)
    listed = joined(parted.select(by, "_chunk").distinct(), found, [by, "_chunk"], "left")
    before = F.last("cut", ignorenulls=True).over(Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    listed = _small(listed.select(by, "_chunk", "cut", before.alias("_before")))
    first = F.lit(-(1 << 63)).cast("long")
    told = joined(parted, listed, [by, "_chunk"]).withColumn("_seg", F.coalesce(F.when(F.col("frame") >= F.col("cut"), F.col("cut")), "_before", first)).drop("_chunk", "cut", "_before")

    def tracked(part: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(frame, gaps before the row in its piece, number of its track since the last gap)."""
        group, frame, box = _arrays(part, starts)
        last = follow(_frames(group, frame), *pairs(group, frame, box, threshold, max_age))
        root = np.where(last < 0, np.arange(len(last)), last)
        while (root[root] != root).any():
            root = root[root]
        gap = np.concatenate([[0], (np.diff(frame) > max_age) & (np.diff(group) == 0)]).astype(np.int64)
        births, gaps = np.cumsum(last < 0), np.cumsum(gap)
        begins = gap > 0
        begins[starts] = True
        since = np.maximum.accumulate(np.where(begins, np.arange(len(frame)), 0))
        return frame, gaps - gaps[starts][group], births[root] - births[since] + 1

    def counted(part: pa.Table, starts: np.ndarray) -> pa.Table:
        frame, gaps, number = tracked(part, starts)
        ends = np.append(starts[1:], len(part)) - 1
        # the tracks since a piece's last gap
        split = np.flatnonzero(np.concatenate([[True], (np.diff(gaps) != 0)]) | np.isin(np.arange(len(gaps)), starts))
        most = np.maximum.reduceat(number, split)[np.searchsorted(split, ends, side="right") - 1]
        out = part.select([by, "_seg"]).take(pa.array(starts))
        for name, values in (("first", frame[starts]), ("last", frame[ends]), ("gaps", gaps[ends]), ("born", most)):
            out = out.append_column(name, pa.array(values))
        return out

    order = ["frame", *BOX]
    sums = whole_groups(told.select(by, "_seg", *order), [by, "_seg"], order, counted, f"`{by}` {kind}, _seg long, first long, last long, gaps long, born long", AT_ONCE)

    def add(camera: pd.DataFrame) -> pd.DataFrame:
        camera = camera.sort_values("_seg")
        piece, born, end, out = 0, 0, None, []
        for r in camera.itertuples():
            if end is not None and r.first - end > max_age:
                piece, born = piece + 1, 0
            out.append((piece, born))
            piece, born, end = piece + r.gaps, r.born + (0 if r.gaps else born), r.last
        return camera[[by, "_seg"]].assign(_piece=[o[0] for o in out], _born=[o[1] for o in out])

    offsets = _small(deal(sums, by).groupBy(by).applyInPandas(add, f"`{by}` {kind}, _seg long, _piece long, _born long"))

    def run(part: pa.Table, starts: np.ndarray) -> pa.Table:
        _, gaps, number = tracked(part, starts)
        piece = part["_piece"].to_numpy() + gaps
        number = number + np.where(gaps == 0, part["_born"].to_numpy(), 0)
        name = pc.binary_join_element_wise(pa.array(piece).cast(pa.string()), pa.array(number).cast(pa.string()), "-")
        return part.drop_columns(["_seg", "_piece", "_born"]).append_column("track_id", name)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return whole_groups(joined(told, offsets, [by, "_seg"]), [by, "_seg"], order, run, f"{fields}, track_id string", AT_ONCE)

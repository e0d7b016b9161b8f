"""Operators on ordered rows of a track, as windows; `by` names the track, `order` the order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Ticks that are made at once, at least.
TICKS = 16_384


def window(by: list[str], order: list[str]) -> WindowSpec:
    """Rows of a track in order."""
    return Window.partitionBy(*by).orderBy(*order)


def deal(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` over as many tasks as there are shuffle partitions, by keys: for work in Python, which is much for few bytes, so that partitions must not be merged by size, nor stay where a coarser key put them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def whole_groups(rows: DataFrame, by: list[str], order: list[str], run, schema, least: int = 1) -> DataFrame:
    """`run` on Arrow tables of whole groups in order, many to a table, and the places in it where groups begin; it returns a table, or yields several.

    A task sorts its rows and holds one batch, one group and `least` of them, so that small groups cost no call each.
    """
    numbered = deal(rows, *by).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*(F.col(c).asc_nulls_last() for c in order))))

    def batches(arrived):
        held: list[pa.RecordBatch] = []

        def done():
            table = pa.Table.from_batches(held).combine_chunks()
            out = run(table.drop_columns(["_k"]), np.flatnonzero(table["_k"].to_numpy() == 1))
            for part in [out] if isinstance(out, pa.Table) else out:
                yield from part.to_batches()

        for batch in arrived:
            first = np.flatnonzero(batch.column(batch.schema.get_field_index("_k")).to_numpy() == 1)
            if len(first) and (held or first[-1] > 0) and sum(map(len, held)) + first[-1] >= least:
                held.append(batch.slice(0, first[-1]))
                yield from done()
                held, batch = [], batch.slice(first[-1])
            held.append(batch)
        if sum(map(len, held)):
            yield from done()

    return numbered.mapInArrow(batches, schema)


def whole_pairs(rows: DataFrame, others: DataFrame, by: list[str], order: list[str], of: list[str], run, schema) -> DataFrame:
    """`run` on Arrow tables of whole groups of `rows` and of the `others` of the same groups, in order (`order` and `of`), many groups at a time: run(rows, how many of each group, others, how many of each).

    A cogroup without a call for each group.  Groups without rows are left out.
    """
    sides = []
    for side, (df, name) in enumerate(((others, "_other"), (rows, "_row"))):
        packed = df.select(*by, F.lit(side).alias("_side"), F.struct(*(c for c in df.columns if c not in by)).alias(name))
        sides.append((packed, name))
    (second, other), (first, row) = sides
    both = first.withColumn(other, F.lit(None).cast(second.schema[other].dataType)).unionByName(second.withColumn(row, F.lit(None).cast(first.schema[row].dataType)))

    def unpacked(table: pa.Table, name: str, some: np.ndarray) -> pa.Table:
        table = table.take(np.flatnonzero(some)).combine_chunks()
        kind, columns = table.schema.field(name).type, {c: table[c] for c in by}
        parts = table[name].combine_chunks() if len(table) else pa.array([], kind)
        return pa.table(columns | {kind.field(i).name: v for i, v in enumerate(parts.flatten())})

    def split(table: pa.Table, starts: np.ndarray) -> pa.Table:
        side = table["_side"].to_numpy() == 1
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(table)]))
        n, m = (np.bincount(group[s], minlength=len(starts)) for s in (side, ~side))
        return run(unpacked(table, row, side), n[n > 0], unpacked(table, other, ~side & (n[group] > 0)), m[n > 0])

    return whole_groups(both, by, ["_side", *(f"_row.{c}" for c in order), *(f"_other.{c}" for c in of)], split, schema)


def grid(column: pa.ChunkedArray, width: int, empty: float, kind) -> tuple[np.ndarray, np.ndarray]:
    """(a list in a row, filled up with `empty`; its length, 0 for null)."""
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), size, 0)
    out = np.full((len(lists), width), empty, kind)
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, size


def lists(values: np.ndarray, size: np.ndarray, some: np.ndarray | None = None) -> pa.Array:
    """`values` as lists of these lengths; null where not `some`, whose lengths are 0."""
    mask = None if some is None else pa.array(~some)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values), mask=mask)


def with_column(table: pa.Table, name: str, values: np.ndarray) -> pa.Table:
    """`table` with a column's values replaced, of the type it has."""
    at = table.schema.get_field_index(name)
    return table.set_column(at, table.schema.field(at), pa.array(values, table.schema.field(at).type))


def collapse(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before, nulls being equal to each other."""
    return rows.withColumn("_p", F.lag(F.struct(value)).over(window(by, order))).where("_p is null or not (_p." + value + " <=> " + value + ")").drop("_p")


def islands(rows: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """`rows` with the number, from 0, of the island each is in; `starts` is true where a new one begins."""
    w = window(by, order)
    flag = F.when(F.row_number().over(w) == 1, F.lit(0)).when(starts, F.lit(1)).otherwise(F.lit(0))
    return rows.withColumn("_f", flag).withColumn(name, F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def speed_kmh(x: Column, y: Column, t: Column, w: WindowSpec) -> Column:
    """Speed since the row before, from metres and seconds; null for the first row and where no time passed."""
    dt = F.nullif(t - F.lag(t).over(w), F.lit(0.0))
    return F.hypot(x - F.lag(x).over(w), y - F.lag(y).over(w)) / dt * 3.6


def split_on_jumps(rows: DataFrame, by: list[str], order: list[str], limit_kmh: float = 200.0, least: int = 2) -> DataFrame:
    """Tracks (x, y, t) cut where the speed exceeds the limit; pieces of fewer than `least` rows go.

    segment_id is the last of `by`, with #n where a track has several pieces.
    """
    w = window(by, order)
    cut = islands(rows, by, order, F.coalesce(speed_kmh(F.col("x"), F.col("y"), F.col("t"), w) > limit_kmh, F.lit(False)), "piece")
    sized = cut.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "piece"))).withColumn("_m", F.max("piece").over(Window.partitionBy(*by)))
    ident = F.when(F.col("_m") > 0, F.concat(F.col(by[-1]).cast("string"), F.lit("#"), F.col("piece").cast("string"))).otherwise(F.col(by[-1]).cast("string"))
    return sized.where(F.col("_n") >= least).withColumn("segment_id", ident).drop("_n", "_m")


def timeline(rows: DataFrame, fps: float) -> DataFrame:
    """Rows with finite coordinates and t in seconds from `frame`."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    return rows.where(finite[0] & finite[1]).withColumn("t", F.col("frame") / fps)


def median_filter(value: str, w: WindowSpec, half: int = 2) -> Column:
    """Median of the rows around, fewer at the ends."""
    return F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-half, half))


def moving_average(value: str, by: list[str], order: list[str], half: int) -> Column:
    """Mean of 2 * half + 1 rows around, the first and last value standing for those beyond the ends."""
    w = window(by, order)
    place = F.row_number().over(w)
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count(F.lit(1)).over(whole)
    missing_left, missing_right = F.greatest(F.lit(0), half - (place - 1)), F.greatest(F.lit(0), half - (n - place))
    total = F.sum(value).over(w.rowsBetween(-half, half)) + missing_left * F.first(value).over(whole) + missing_right * F.last(value).over(whole)
    return total / float(2 * half + 1)


def with_arc_length(rows: DataFrame, by: list[str], order: list[str], name: str = "s") -> DataFrame:
    """`rows` (x, y) with the distance from the track's first row."""
    w = window(by, order)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return rows.withColumn("_step", step).withColumn(name, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def interpolate(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Nulls between known values become linear in `order`, those beyond the ends the nearest known value."""
    w = window(by, [order])
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    out = rows.withColumn("_a", F.last(known, True).over(before)).withColumn("_b", F.first(known, True).over(after))
    share = (F.col(order) - F.col("_a.o")) / F.nullif(F.col("_b.o") - F.col("_a.o"), F.lit(0))
    line = F.col("_a.v") + F.coalesce(share, F.lit(0.0)) * (F.col("_b.v") - F.col("_a.v"))
    return out.withColumn(name, F.coalesce(F.col(value), line, F.col("_a.v"), F.col("_b.v"))).drop("_a", "_b")


def resample(rows: DataFrame, by: list[str], step: float, t: str = "t", values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Values at multiples of `step` within each track.

    Catmull-Rom where the two rows on either side exist and the intervals
    around differ by less than a fifth, else linear.  The ticks between two rows
    are made in blocks, so that a task's memory grows with the gap's root at most.
    """
    w = window(by, [t])
    out = deal(rows, *by).select(*by, F.col(t).alias("t1"), *(F.col(v).alias(f"{v}1") for v in values), F.lead(t).over(w).alias("t2"), F.lag(t).over(w).alias("t0"), F.lead(t, 2).over(w).alias("t3"), *(f(v).over(w).alias(f"{v}{k}") for v in values for k, f in ((0, F.lag), (2, F.lead))), *(F.lead(v, 2).over(w).alias(f"{v}3") for v in values)).where("t2 > t1")
    first = F.ceil(F.col("t1") / step).cast("long")
    last = (F.ceil(F.col("t2") / step) - 1).cast("long")
    widths = F.array(F.col("t1") - F.col("t0"), F.col("t2") - F.col("t1"), F.col("t3") - F.col("t2"))
    smooth = F.col("t0").isNotNull() & F.col("t3").isNotNull() & (F.array_max(widths) < 1.2 * F.array_min(widths))
    gaps = out.withColumns({"_first": first, "_last": last, "_smooth": smooth}).where("_first <= _last").withColumn("_size", F.greatest(F.lit(TICKS), F.ceil(F.sqrt(F.col("_last") - F.col("_first") + 1))))
    blocks = gaps.withColumn("_from", F.explode(F.sequence("_first", "_last", "_size")))
    # explodes next to each other hold all rows that they make of one; coalesce, to more partitions than there are, sets them apart
    ticks = blocks.coalesce(2**30).withColumn("tick", F.explode(F.sequence("_from", F.least("_last", F.col("_from") + F.col("_size") - 1)))).withColumn("u", (F.col("tick") * step - F.col("t1")) / (F.col("t2") - F.col("t1")))

    def at(v: str) -> Column:
        p0, p1, p2, p3, u = (F.col(c) for c in (f"{v}0", f"{v}1", f"{v}2", f"{v}3", "u"))
        curve = 0.5 * (2.0 * p1 + (p2 - p0) * u + (2.0 * p0 - 5.0 * p1 + 4.0 * p2 - p3) * u * u + (3.0 * p1 - p0 - 3.0 * p2 + p3) * u * u * u)
        return F.when(F.col("_smooth"), curve).otherwise(p1 + (p2 - p1) * u)

    return ticks.select(*by, "tick", *(at(v).alias(v) for v in values))


def longest_run(rows: DataFrame, by: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Rows of the longest run of each track, the first on ties; `breaks` is true where a run begins anew."""
    runs = islands(rows, by, order, breaks, "_run")
    counts = runs.groupBy(*by, "_run").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(F.max(F.struct("n", (-F.col("_run")).alias("r"))).alias("b")).select(*by, (-F.col("b.r")).alias("_run"))
    return runs.join(best, [*by, "_run"], "left_semi").drop("_run")


def jitter_radius(x: str, y: str, w: WindowSpec, last: int = 8) -> Column:
    """Diagonal of the box around the last rows."""
    recent = w.rowsBetween(1 - last, 0)
    return F.hypot(F.max(x).over(recent) - F.min(x).over(recent), F.max(y).over(recent) - F.min(y).over(recent))


def ema(rows: DataFrame, by: list[str], order: str, value: str, alpha: float, name: str = "ema") -> DataFrame:
    """Exponential mean over each track's rows in order, starting at its first value: rows (by, order, name).  A null leaves the mean as it was.

    The mean is a weighted sum of the values so far.  Values are numbered in
    stretches long enough for the weight of all before the last two stretches
    to vanish in a double, so windows of running sums do, however long a track is.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must be between 0 and 1")
    keep = 1.0 - alpha
    length = math.ceil(18.0 * math.log(10.0) / -math.log(keep))
    w = window(by, [order])
    k = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    numbered = rows.select(*by, order, F.col(value).cast("double").alias("_v"), k.alias("_k"))
    at = F.col("_k") % length
    # the first value has weight 1, not alpha; within a stretch weights grow from 1 on
    gain = F.when(F.col("_k") == 0, F.lit(1.0)).otherwise(alpha) * F.pow(F.lit(keep), (-at).cast("double")) * F.col("_v")
    staged = numbered.withColumn("_part", F.when(F.col("_k") >= 0, F.floor(F.col("_k") / length))).withColumn("_gain", gain)
    inside = window([*by, "_part"], [order]).rowsBetween(Window.unboundedPreceding, 0)
    staged = staged.withColumn("_own", F.sum("_gain").over(inside) * F.pow(F.lit(keep), at.cast("double")))
    ends = staged.where("_part is not null").groupBy(*by, "_part").agg(F.max_by("_own", "_k").alias("_end"))
    before = window(by, ["_part"])
    carried = ends.select(*by, "_part", (F.lag("_end", 1, 0.0).over(before) + F.lag("_end", 2, 0.0).over(before) * keep**length).alias("_carried"))
    nulls = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_part"]]
    joined = staged.alias("l").join(carried.alias("r"), nulls, "left")
    return joined.select(*(F.col(f"l.{c}").alias(c) for c in [*by, order]), (F.col("_own") + F.coalesce("_carried", F.lit(0.0)) * F.pow(F.lit(keep), (at + 1).cast("double"))).alias(name))


def _first_wide(x: np.ndarray, y: np.ndarray, rows: np.ndarray, least: float) -> np.ndarray:
    """For each of `rows` the smallest k for which the box around rows i - k to i + k has a diagonal of `least`; the number of rows if there is none.

    A chord within a smaller box is shorter, so none needs a look before.
    """
    n = len(x)
    tables = []  # least and largest of x and y over 2**j rows from each on
    for v, f in ((x, np.minimum), (x, np.maximum), (y, np.minimum), (y, np.maximum)):
        levels = [v]
        while 2 ** len(levels) <= n:
            half = 2 ** (len(levels) - 1)
            levels.append(f(levels[-1][:-half], levels[-1][half:]))
        tables.append((f, levels))

    def wide(k: np.ndarray) -> np.ndarray:
        a, b = np.maximum(0, rows - k), np.minimum(n - 1, rows + k)
        level = np.floor(np.log2(b - a + 1)).astype(int)
        side = np.empty((4, len(rows)))
        for j in np.unique(level):
            at = level == j
            for m, (f, levels) in enumerate(tables):
                side[m, at] = f(levels[j][a[at]], levels[j][b[at] - 2**j + 1])
        return np.hypot(side[1] - side[0], side[3] - side[2]) >= least * (1 - 1e-12)

    low, high = np.ones(len(rows), int), np.full(len(rows), n)
    while (low < high).any():
        middle = (low + high) // 2
        ok = wide(middle)
        high, low = np.where(ok, middle, high), np.where(ok, low, np.minimum(middle + 1, high))
    return np.where(wide(low), low, n)


def headings(rows: DataFrame, by: list[str], order: list[str], least: float = 0.6) -> DataFrame:
    """`rows` (x, y, heading) with missing headings filled from the chord of a symmetric stretch around the row, grown until it is `least` metres long; else the track's mean direction.

    One pass over a track in one task; stretches too small for such a chord are
    passed over by halving, so a track that stands costs no more than one that moves.
    """

    def fill(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values(order, kind="stable").reset_index(drop=True)
        x, y, h = (track[c].to_numpy(float).copy() for c in ("x", "y", "heading"))
        n = len(x)
        todo = np.flatnonzero(np.isnan(h))
        k = _first_wide(x, y, todo, least) if n > 1 and len(todo) else np.full(len(todo), n)
        while len(todo):
            a, b = np.maximum(0, todo - k), np.minimum(n - 1, todo + k)
            dx, dy = x[b] - x[a], y[b] - y[a]
            done = (np.hypot(dx, dy) >= least) & (k < n)
            h[todo[done]] = np.degrees(np.arctan2(dy[done], dx[done]))
            left = ~done & ((a > 0) | (b < n - 1))
            todo, k = todo[left], k[left] + 1
        known = np.radians(h[~np.isnan(h)])
        if len(known):
            h[np.isnan(h)] = np.degrees(np.arctan2(np.sin(known).sum(), np.cos(known).sum()))
        track["heading"] = h
        return track

    return deal(rows, *by).groupBy(*by).applyInPandas(fill, rows.schema)

"""Fitting a drawn map to an image: cost surfaces over shifts, refinement, residuals, local shifts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial_join import nearest


def grid(spark, reach: float, step: float) -> DataFrame:
    """Rows (dx, dy): all shifts up to `reach` on a square grid."""
    n = int(round(reach / step))
    return spark.range(-n, n + 1).select((F.col("id") * step).alias("dx")).crossJoin(spark.range(-n, n + 1).select((F.col("id") * step).alias("dy")))


def surface(points: DataFrame, field: DataFrame, shifts: DataFrame, cell: float, truncate: float) -> DataFrame:
    """Rows (dx, dy, cost): mean over points of the field's value (x, y as whole cells, value) below each shifted point, at most `truncate`, which also stands for points off the field.

    shifts is a grid of a fixed size that goes to every task; costs add up
    before the shuffle, one row for each shift.
    """
    moved = points.crossJoin(F.broadcast(shifts)).select("dx", "dy", F.floor((F.col("x") + F.col("dx")) / cell).cast("int").alias("_i"), F.floor((F.col("y") + F.col("dy")) / cell).cast("int").alias("_j"))
    f = field.select(F.col("x").alias("_i"), F.col("y").alias("_j"), "value")
    cost = F.least(F.lit(float(truncate)), F.coalesce("value", F.lit(float(truncate))))
    return moved.join(f, ["_i", "_j"], "left").groupBy("dx", "dy").agg(F.avg(cost).alias("cost"))


def best_shift(costs: DataFrame) -> DataFrame:
    """The cheapest row."""
    return costs.orderBy("cost", "dx", "dy").limit(1)


def contrast(costs: DataFrame) -> DataFrame:
    """One row: how far the least cost is below the median."""
    return costs.agg(F.min("cost").alias("least"), F.percentile("cost", F.lit(0.5)).alias("middle")).select("least", "middle", ((F.col("middle") - F.col("least")) / F.nullif("middle", F.lit(0.0))).alias("contrast"))


def anisotropy(costs: DataFrame, share: float = 0.1, least: int = 6) -> DataFrame:
    """One row: axes of the valley of cells whose cost is within `share` of the way from the least to the median; null for fewer than `least` cells."""
    c = costs.crossJoin(F.broadcast(contrast(costs)))
    low = c.where(F.col("cost") <= F.col("least") + share * (F.col("middle") - F.col("least")))
    m = low.agg(F.count(F.lit(1)).alias("n"), F.var_samp("dx").alias("xx"), F.var_samp("dy").alias("yy"), F.covar_samp("dx", "dy").alias("xy"))
    half, root = (F.col("xx") + F.col("yy")) / 2.0, F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) / 4.0 + F.col("xy") * F.col("xy"))
    enough = F.col("n") >= least
    return m.select("n", F.when(enough, F.sqrt(half + root)).alias("major"), F.when(enough, F.sqrt(F.greatest(F.lit(0.0), half - root))).alias("minor"))


def bilinear(points: DataFrame, field: DataFrame, outside: float) -> DataFrame:
    """`points` (id, x, y in cells) with the field's value between the four cells around; `outside` where one is missing."""
    corners = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    each = points.withColumn("_x", F.floor("x").cast("int")).withColumn("_y", F.floor("y").cast("int")).withColumn("c", F.explode(corners))
    fx, fy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    weight = F.when(F.col("c.i") == 1, fx).otherwise(1.0 - fx) * F.when(F.col("c.j") == 1, fy).otherwise(1.0 - fy)
    each = each.select("id", weight.alias("w"), (F.col("_x") + F.col("c.i")).alias("_i"), (F.col("_y") + F.col("c.j")).alias("_j"))
    hit = each.join(field.select(F.col("x").alias("_i"), F.col("y").alias("_j"), "value"), ["_i", "_j"], "left")
    s = hit.groupBy("id").agg(F.sum(F.col("w") * F.col("value")).alias("v"), F.count_if(F.col("value").isNull() & (F.col("w") > 0)).alias("missing"))
    return points.join(s.select("id", F.when(F.col("missing") == 0, F.col("v")).otherwise(F.lit(float(outside))).alias("value")), "id")


def chamfer(a: DataFrame, b: DataFrame, truncate: float, both_ways: bool = False) -> DataFrame:
    """One row: mean distance from points (id, x, y) of `a` to the nearest of `b`, at most `truncate`; of both directions if so asked."""

    def one(p: DataFrame, q: DataFrame) -> DataFrame:
        near = nearest(p, q, "id", "id", distance=truncate)
        return near.agg(F.avg(F.least(F.lit(float(truncate)), F.coalesce("distance", F.lit(float(truncate))))).alias("d"))

    way = one(a, b)
    return way.unionByName(one(b, a)).agg(F.avg("d").alias("chamfer")) if both_ways else way.select(F.col("d").alias("chamfer"))


def residuals(distance: str, rows: DataFrame) -> DataFrame:
    """One row: mean, median, and shares within one and two metres."""
    d = F.col(distance)
    return rows.agg(F.avg(d).alias("mean"), F.percentile(d, F.lit(0.5)).alias("median"), (100.0 * F.avg((d < 1.0).cast("double"))).alias("within_1m_pct"), (100.0 * F.avg((d < 2.0).cast("double"))).alias("within_2m_pct"))


def densify(lines: DataFrame, step: float, key: str = "link_id") -> DataFrame:
    """Points every `step` or nearer along the segments of lines (key, pts), ends included once for each segment's start and the line's end."""
    from .spatial_join import segments

    seg = segments(lines, key)
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / step).cast("int"))
    last = F.max("n").over(Window.partitionBy(key))
    each = seg.withColumn("_n", n).withColumn("_last", last).withColumn("_i", F.explode(F.sequence(F.lit(0), F.when(F.col("n") == F.col("_last"), F.col("_n")).otherwise(F.col("_n") - 1))))
    t = F.col("_i") / F.col("_n")
    return each.select(key, "n", F.col("_i").alias("i"), (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))


def local_shifts(points: DataFrame, field: DataFrame, shifts: DataFrame, cell: float, truncate: float, tile: float, least: int = 300, reach: float | None = None, least_contrast: float = 0.05) -> DataFrame:
    """Rows (ti, tj, n, dx, dy, contrast): the best shift of each tile of the map with enough points; not where it is at the edge of the search or hardly better than others."""
    tiled = points.withColumn("ti", F.floor(F.col("x") / tile).cast("int")).withColumn("tj", F.floor(F.col("y") / tile).cast("int"))
    counts = tiled.groupBy("ti", "tj").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    some = tiled.join(counts, ["ti", "tj"])
    moved = some.crossJoin(F.broadcast(shifts)).select("ti", "tj", "n", "dx", "dy", F.floor((F.col("x") + F.col("dx")) / cell).cast("int").alias("_i"), F.floor((F.col("y") + F.col("dy")) / cell).cast("int").alias("_j"))
    f = field.select(F.col("x").alias("_i"), F.col("y").alias("_j"), "value")
    cost = moved.join(f, ["_i", "_j"], "left").groupBy("ti", "tj", "n", "dx", "dy").agg(F.avg(F.least(F.lit(float(truncate)), F.coalesce("value", F.lit(float(truncate))))).alias("cost"))
    best = cost.groupBy("ti", "tj", "n").agg(F.min_by(F.struct("dx", "dy"), F.struct("cost", "dx", "dy")).alias("b"), F.min("cost").alias("least"), F.percentile("cost", F.lit(0.5)).alias("middle"))
    out = best.select("ti", "tj", "n", "b.dx", "b.dy", ((F.col("middle") - F.col("least")) / F.nullif("middle", F.lit(0.0))).alias("contrast")).where(F.col("contrast") >= least_contrast)
    return out.where((F.abs("dx") < reach) & (F.abs("dy") < reach)) if reach is not None else out


def refine(cost: Callable[[np.ndarray], float], start: np.ndarray, step: np.ndarray, bounds: np.ndarray | None = None, rounds: int = 60, shrink: float = 0.5, least: float = 1e-4) -> tuple[np.ndarray, float]:
    """(parameters, cost) by searching along each axis and along the last round's move; a round without gain shrinks the steps.  Outside the bounds nothing is accepted."""
    x, step = np.asarray(start, float).copy(), np.asarray(step, float).copy()
    best = cost(x)

    def attempt(y: np.ndarray) -> bool:
        nonlocal x, best
        if bounds is not None and ((y < bounds[0]) | (y > bounds[1])).any():
            return False
        c = cost(y)
        if c < best:
            x, best = y, c
            return True
        return False

    for _ in range(rounds):
        before, won = x.copy(), False
        for i in range(len(x)):
            for sign in (1.0, -1.0):
                move = np.zeros_like(x)
                move[i] = sign * step[i]
                while attempt(x + move):
                    won = True
        if won:
            attempt(x + (x - before))
        else:
            step *= shrink
            if (np.abs(step) < least).all():
                break
    return x, best


def apply_similarity(x: Column, y: Column, centre: tuple[float, float], dx: float, dy: float, degrees: float, scale: float) -> tuple[Column, Column]:
    """A point turned and scaled about a centre, then shifted."""
    c, s = scale * float(np.cos(np.radians(degrees))), scale * float(np.sin(np.radians(degrees)))
    u, v = x - centre[0], y - centre[1]
    return centre[0] + c * u - s * v + dx, centre[1] + s * u + c * v + dy


def even(rows: DataFrame, n: int, key: str) -> DataFrame:
    """About n rows spread evenly over the order of `key`: rows number floor(i * (size - 1) / (n - 1)).

    A sample for a report or a coarse search; the numbering is by ranges, so
    that no task orders all rows.
    """
    size = rows.count()
    if size <= n:
        return rows
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    before = local.groupBy("_part").agg(F.count(F.lit(1)).alias("c")).select("_part", F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    at = F.col("_n") + F.col("_b") - 1
    wanted = F.floor(F.ceil(at * (n - 1) / float(size - 1)) * (size - 1) / float(n - 1)) == at
    return local.join(F.broadcast(before), "_part").where(wanted).drop("_part", "_n", "_b")

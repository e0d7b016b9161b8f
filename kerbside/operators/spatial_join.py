"""Distance joins by square cells.

Two tables of points meet by an equi-join on cells as wide as the distance: each
row of the smaller (right) side is repeated for the nine cells around it, and
the exact distance decides.  No pair farther than two cells is ever formed, so
the work follows the number of near pairs, not the product of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import on_segment
from .graph import cut


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def _around(c: Column) -> Column:
    return F.sequence(c - 1, c + 1)


def within_distance(left: DataFrame, right: DataFrame, distance: float, *, inclusive: bool = True) -> DataFrame:
    """Pairs at most (or less than) `distance` apart: all columns of `left`, those of `right` with `r_` before, and distance.

    Both have x and y; rows where one is null pair with nothing.
    """
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).where("r_x is not null and r_y is not null")
    r = r.withColumn("_cx", F.explode(_around(_cell(F.col("r_x"), distance)))).withColumn("_cy", F.explode(_around(_cell(F.col("r_y"), distance))))
    pairs = left.withColumn("_cx", _cell(F.col("x"), distance)).withColumn("_cy", _cell(F.col("y"), distance)).join(r, ["_cx", "_cy"]).drop("_cx", "_cy")
    pairs = pairs.withColumn("distance", F.hypot(F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y")))
    return pairs.where(F.col("distance") <= distance if inclusive else F.col("distance") < distance)


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, *, distance: float | None = None) -> DataFrame:
    """For each row of `left` (by key) the nearest row of `right`: key, r_<right_key>, distance; the smaller right key on ties.

    With `distance`, only neighbours within it; without, rings grow fourfold for
    the rows that have none yet, from the mean distance of the right side's
    points.  Rows without a neighbour have nulls.
    """

    def best(rows: DataFrame, reach: float) -> DataFrame:
        near = within_distance(rows, right, reach)
        return near.groupBy(key).agg(F.min(F.struct("distance", f"r_{right_key}")).alias("b")).select(key, F.col(f"b.r_{right_key}").alias(f"r_{right_key}"), "b.distance")

    points = left.select(key, "x", "y")
    if distance is not None:
        return left.select(key).join(best(points, distance), key, "left")
    box = right.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    none = left.select(key, F.lit(None).cast(right.schema[right_key].dataType).alias(f"r_{right_key}"), F.lit(None).cast("double").alias("distance"))
    if not box.n:
        return none
    # the mean distance of points spread evenly over the box, or along its longer side
    reach = max((float(box.w) * float(box.h) / box.n) ** 0.5, max(float(box.w), float(box.h)) / box.n, 1e-6)
    found, rest = None, cut(points.where("x is not null and y is not null"))
    while rest.limit(1).count():
        part = cut(best(rest, reach))
        found = part if found is None else found.unionByName(part)
        rest = cut(rest.join(part.select(key), key, "left_anti"))
        reach *= 4.0
    return left.select(key).join(found, key, "left") if found is not None else none


def top_k(pairs: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key, with rank from 1."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def nearest_k(left: DataFrame, right: DataFrame, key: str, right_key: str, k: int, distance: float) -> DataFrame:
    """Up to k neighbours within `distance`, nearest first, then by right key.

    Rings grow fourfold, up to `distance`, for the rows that have fewer than k yet, from the reach in which
    points spread evenly over their box would have some k: pairs follow the results, not the density.
    """

    def best(rows: DataFrame, reach: float) -> DataFrame:
        return top_k(within_distance(rows, right, reach), key, ["distance", f"r_{right_key}"], k)

    box = right.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    reach = max((k * float(box.w) * float(box.h) / box.n) ** 0.5, k * max(float(box.w), float(box.h)) / box.n, 1e-6) if box.n else distance
    found, rest = None, left
    while reach < distance:
        part = cut(best(rest, reach))
        full = part.where(F.col("rank") == k).select(key)
        done = part.join(full, key, "left_semi")
        found = done if found is None else found.unionByName(done)
        rest = cut(rest.join(full, key, "left_anti"))
        if not rest.limit(1).count():
            return found
        reach *= 4.0
    last = best(rest, distance)
    return last if found is None else found.unionByName(last)


def without_neighbours(left: DataFrame, right: DataFrame, key: str, distance: float, *, inclusive: bool = False) -> DataFrame:
    """Rows of `left` that have no row of `right` nearer than (or at) `distance`.

    Two points in one cell half as wide are surely near, so that cells do for most rows; those of cells
    without a right point meet the different right points around.
    """
    half = distance / 2.0
    points = left.select(key, "x", "y").where("x is not null and y is not null").withColumns({"_hx": _cell(F.col("x"), half), "_hy": _cell(F.col("y"), half)})
    places = right.select("x", "y").where("x is not null and y is not null").distinct()
    cells = places.select(_cell(F.col("x"), half).alias("_hx"), _cell(F.col("y"), half).alias("_hy")).distinct()
    same = points.join(cells, ["_hx", "_hy"], "left_semi").select(key)
    rest = points.join(cells, ["_hx", "_hy"], "left_anti").select(key, "x", "y")
    near = same.unionByName(within_distance(rest, places, distance, inclusive=inclusive).select(key)).distinct()
    return left.join(near, key, "left_anti")


def neighbours(points: DataFrame, key: str, distance: float) -> DataFrame:
    """Pairs (key < r_key) of one table within `distance`."""
    return within_distance(points, points, distance).where(F.col(key) < F.col(f"r_{key}"))


def segments(links: DataFrame, key: str = "link_id") -> DataFrame:
    """Rows (key, n, ax, ay, bx, by, s0, length): the segments of links with pts array<struct<x,y>>, and where each begins along the link."""
    each = links.select(key, F.posexplode(F.arrays_zip(F.expr("slice(pts, 1, size(pts) - 1)").alias("a"), F.expr("slice(pts, 2, size(pts) - 1)").alias("b"))).alias("n", "ab")).where("ab.a is not null and ab.b is not null")
    out = each.select(key, "n", F.col("ab.a.x").alias("ax"), F.col("ab.a.y").alias("ay"), F.col("ab.b.x").alias("bx"), F.col("ab.b.y").alias("by")).withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    along = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("s0", F.coalesce(F.sum("length").over(along), F.lit(0.0)))


def project_onto(points: DataFrame, links: DataFrame, key: str, distance: float, link: str = "link_id") -> DataFrame:
    """Foot of each point on each link within `distance`: columns of points, link, s, d (left positive), foot_x, foot_y, distance, bearing.

    Segments are cut into pieces no longer than a cell, which meet points by cells.
    """
    seg = segments(links, link)
    steps = F.greatest(F.lit(1), F.ceil(F.col("length") / distance).cast("int"))
    cut = seg.withColumn("_steps", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_steps"))))
    t = F.col("_i") / F.col("_steps")
    # a point within `distance` of the segment is within 1.5 cells of one of its cut points
    reach = distance * 1.5
    cells = cut.select(link, "n", _cell(F.col("ax") + t * (F.col("bx") - F.col("ax")), reach).alias("_cx"), _cell(F.col("ay") + t * (F.col("by") - F.col("ay")), reach).alias("_cy"))
    cells = cells.withColumn("_cx", F.explode(_around(F.col("_cx")))).withColumn("_cy", F.explode(_around(F.col("_cy")))).distinct()
    placed = points.withColumn("_cx", _cell(F.col("x"), reach)).withColumn("_cy", _cell(F.col("y"), reach))
    pairs = placed.join(cells, ["_cx", "_cy"]).drop("_cx", "_cy").join(seg, [link, "n"])
    foot = on_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    pairs = pairs.withColumn("f", foot).where(F.col("f.dist") <= distance)
    best = F.min(F.struct(F.col("f.dist").alias("distance"), "n", (F.col("s0") + F.col("f.t") * F.col("length")).alias("s"), F.col("f.side").alias("d"), F.col("f.x").alias("foot_x"), F.col("f.y").alias("foot_y"), F.degrees(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))).alias("bearing"))).alias("b")
    own = [c for c in points.columns if c != key]
    out = pairs.groupBy(key, link).agg(best, *(F.first(c).alias(c) for c in own))
    return out.select(key, *own, link, "b.s", "b.d", "b.foot_x", "b.foot_y", "b.distance", "b.bearing")


def nearest_bearing(points: DataFrame, links: DataFrame, key: str, distance: float) -> DataFrame:
    """Rows (key, link_id, bearing): the direction of the nearest link's nearest segment within `distance`, the smaller link on ties."""
    found = project_onto(points, links, key, distance)
    return found.groupBy(key).agg(F.min_by(F.struct("link_id", "bearing"), F.struct("distance", "link_id")).alias("b")).select(key, "b.link_id", "b.bearing")


def candidates(points: DataFrame, links: DataFrame, key: str, distance: float = 25.0, k: int = 6, link: str = "link_id", by_lateral: bool = True) -> DataFrame:
    """Up to k links of each point, by absolute lateral distance (or distance), then link."""
    found = project_onto(points, links, key, distance, link)
    return top_k(found, key, [F.abs("d") if by_lateral else F.col("distance"), link], k)

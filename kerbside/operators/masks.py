"""Masks as tables: rectangles, summed areas, pixels, connected regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components

COVER = 0.6


def pixels(box: tuple[Column, Column, Column, Column], width, height) -> tuple[Column, Column, Column, Column]:
    """A box cut to whole pixels of the image."""
    w, h = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))

    def clamp(v: Column, top: Column) -> Column:
        return F.greatest(F.lit(0), F.least(top, v.cast("int")))

    return clamp(box[0], w), clamp(box[1], h), clamp(box[2], w), clamp(box[3], h)


def covered_by(box: tuple[Column, Column, Column, Column], rectangles: list[tuple[int, int, int, int]]) -> Column:
    """Share of a box that lies in rectangles that don't overlap each other; 0 for an empty box."""
    area = (box[2] - box[0]) * (box[3] - box[1])
    total = F.lit(0.0)
    for x1, y1, x2, y2 in rectangles:
        w = F.greatest(F.lit(0), F.least(box[2], F.lit(x2)) - F.greatest(box[0], F.lit(x1)))
        h = F.greatest(F.lit(0), F.least(box[3], F.lit(y2)) - F.greatest(box[1], F.lit(y1)))
        total = total + w * h
    return F.when(area > 0, total / F.nullif(area, F.lit(0))).otherwise(F.lit(0.0))


def drop_covered(rows: DataFrame, share: Column, least: float = COVER) -> DataFrame:
    """Rows whose share is below `least`."""
    return rows.where(share < least)


def summed_area(mask: DataFrame, by: str = "cctv_id") -> DataFrame:
    """Rows (by, x, y, total): masked pixels (by, x, y) left of x and above y, for the corners of boxes.

    One row for each pixel of the bounding box of the mask.
    """
    spans = mask.groupBy(by).agg(F.max("x").alias("w"), F.max("y").alias("h"))
    grid = spans.select(by, F.explode(F.sequence(F.lit(0), F.col("w") + 1)).alias("x"), "h").select(by, "x", F.explode(F.sequence(F.lit(0), F.col("h") + 1)).alias("y"))
    on = mask.select(by, (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), F.lit(1).alias("one")).distinct()
    cells = grid.join(on, [by, "x", "y"], "left").withColumn("one", F.coalesce("one", F.lit(0)))
    row = cells.withColumn("r", F.sum("one").over(Window.partitionBy(by, "y").orderBy("x")))
    return row.select(by, "x", "y", F.sum("r").over(Window.partitionBy(by, "x").orderBy("y")).alias("total"))


def coverage(boxes: DataFrame, area: DataFrame, by: str = "cctv_id", key: str = "box_id") -> DataFrame:
    """Rows (key, masked, share): masked pixels of boxes (key, by, x1..y2 in whole pixels), by four look-ups in the summed area."""
    spans = area.groupBy(by).agg(F.max("x").alias("_w"), F.max("y").alias("_h"))
    b = boxes.join(spans, by, "left")
    corners = F.array(*(F.struct(F.least(F.col(x), F.col("_w")).alias("x"), F.least(F.col(y), F.col("_h")).alias("y"), F.lit(s).alias("sign")) for x, y, s in (("x2", "y2", 1), ("x1", "y2", -1), ("x2", "y1", -1), ("x1", "y1", 1))))
    looked = b.select(key, by, ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("size"), F.explode(corners).alias("c")).select(key, by, "size", "c.x", "c.y", "c.sign").join(area, [by, "x", "y"], "left")
    sums = looked.groupBy(key).agg(F.coalesce(F.sum(F.col("sign") * F.col("total")), F.lit(0)).alias("masked"), F.first("size").alias("size"))
    return sums.select(key, "masked", F.when(F.col("size") > 0, F.col("masked") / F.nullif("size", F.lit(0))).otherwise(F.lit(0.0)).alias("share"))


def inside(boxes: DataFrame, area: DataFrame, method: str = "partial", by: str = "cctv_id", key: str = "box_id") -> DataFrame:
    """Keys of boxes in a region: `partial`, any pixel; `in`, all four corners."""
    if method == "partial":
        return coverage(boxes, area, by, key).where("masked > 0").select(key)
    corners = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("x1", "x2") for y in ("y1", "y2")))
    one = boxes.select(key, by, F.explode(corners).alias("c")).select(F.concat_ws(":", key, "c.x", "c.y").alias("_c"), key, by, F.col("c.x").alias("x1"), F.col("c.y").alias("y1"), (F.col("c.x") + 1).alias("x2"), (F.col("c.y") + 1).alias("y2"))
    hit = coverage(one, area, by, "_c").where("masked > 0").select("_c")
    return one.select("_c", key).distinct().join(hit.withColumn("hit", F.lit(1)), "_c", "left").groupBy(key).agg(F.min(F.coalesce("hit", F.lit(0))).alias("all")).where("all = 1").select(key)


def persistence(boxes: DataFrame, cell: int = 1, by: str = "cctv_id") -> DataFrame:
    """Rows (by, x, y, share): cells and the share of the camera's frames in which a box (by, frame, x1..y2) covers them."""
    frames = boxes.groupBy(by).agg(F.countDistinct("frame").alias("frames"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell).cast("int"), F.greatest(F.floor(F.col(a) / cell), F.ceil(F.col(b) / cell) - 1).cast("int")))
    cells = boxes.withColumn("x", span("x1", "x2")).withColumn("y", span("y1", "y2")).select(by, "frame", "x", "y").distinct()
    return cells.groupBy(by, "x", "y").agg(F.count(F.lit(1)).alias("n")).join(frames, by).select(by, "x", "y", (F.col("n") / F.col("frames")).alias("share"))


def temporal_deviation(samples: DataFrame, by: str = "cctv_id") -> DataFrame:
    """Rows (by, x, y, std): deviation of each pixel (by, frame, x, y, value) over time."""
    return samples.groupBy(by, "x", "y").agg(F.stddev_pop("value").alias("std"))


def median_frame(samples: DataFrame, by: str = "cctv_id") -> DataFrame:
    """Rows (by, x, y, value): the median of each pixel (by, frame, x, y, value) over time, what stands still in the picture."""
    return samples.groupBy(by, "x", "y").agg(F.percentile("value", F.lit(0.5)).alias("value"))


def regions(mask: DataFrame, least: int = 1, by: str = "cctv_id") -> DataFrame:
    """Rows (by, region, area, x1, y1, x2, y2): pixels (by, x, y) that touch at sides or corners, largest first from 0; smaller ones than `least` go."""
    m = mask.select(by, "x", "y").distinct().withColumn("id", F.xxhash64(by, "x", "y"))
    near = m.withColumn("dx", F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1)))))
    edges = near.select(F.col("id").alias("a"), by, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).join(m.withColumnRenamed("id", "b"), [by, "x", "y"]).select("a", "b")
    labelled = m.join(components(edges), "id")
    blobs = labelled.groupBy(by, "component").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2")).where(F.col("area") >= least)
    order = Window.partitionBy(by).orderBy(F.col("area").desc(), "y1", "x1")
    return blobs.withColumn("region", F.row_number().over(order) - 1).drop("component")


def elongated(points: DataFrame, by: list[str], least: float = 1.6) -> DataFrame:
    """Groups of points (by, x, y) at least `least` times as long as wide, by the eigenvalues of their covariance."""
    c = points.groupBy(*by).agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    half, root = (F.col("xx") + F.col("yy")) / 2.0, F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) / 4.0 + F.col("xy") * F.col("xy"))
    ratio = F.sqrt((half + root) / F.greatest(F.lit(1e-9), half - root))
    return c.select(*by, ratio.alias("elongation")).where(F.col("elongation") >= least)


def road_cells(boxes: DataFrame, cell: int, grow: int = 1, by: str = "cctv_id") -> DataFrame:
    """Cells that any box covers, grown by `grow` cells on each side."""
    own = persistence(boxes.withColumn("frame", F.lit(0)), cell, by).select(by, "x", "y")
    steps = F.array(*(F.lit(d) for d in range(-grow, grow + 1)))
    return own.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select(by, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).distinct()

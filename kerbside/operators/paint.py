"""Road paint in images and the distance to it, on tables of pixels (image, x, y, gray).

Images may be mosaics of any size: rows and columns of pixels are windows, so
that a task holds one line at a time.  Missing pixels (tiles that weren't there)
don't count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import deal

#: The least response of a thin bright structure, in grey levels.
LEAST = 6.0


def _over_disc(pixels: DataFrame, value: str, radius: int, pick) -> DataFrame:
    """`pixels` with `value` replaced by its `pick` (F.min or F.max) over a disc: along each row for all widths that the disc has, then across the rows."""
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    width = {dy: round(math.sqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1)}
    wide = pixels.withColumns({f"_w{w}": pick(value).over(row.rangeBetween(-w, w)) for w in sorted(set(width.values()))})
    across = [F.max(f"_w{w}").over(column.rangeBetween(dy, dy)) for dy, w in width.items()]
    chosen = (F.least if pick is F.min else F.greatest)(*across) if len(across) > 1 else across[0]
    return wide.withColumn(value, chosen).select(*pixels.columns)


def top_hat(pixels: DataFrame, radius: int) -> DataFrame:
    """`pixels` with top_hat: how much brighter a pixel is than the brightest disc of `radius` below it, which is what thin bright structures have."""
    opened = _whole(pixels).withColumn("_open", F.col("gray").cast("double"))
    low = _over_disc(opened, "_open", radius, F.min)
    opened = _over_disc(low.withColumn("_open", F.when(F.col("gray").isNotNull(), F.col("_open"))), "_open", radius, F.max)
    return opened.where("gray is not null").withColumn("top_hat", F.col("gray") - F.col("_open")).drop("_open")


def _whole(pixels: DataFrame) -> DataFrame:
    """`pixels`, and those that miss in their image's rows and columns with null grey, as lines of a disc run through them."""
    sizes = pixels.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("x").alias("w"), F.count_distinct("y").alias("h"))
    if not sizes.where("n < w * h").limit(1).count():
        return pixels
    places = pixels.select("image", "x").distinct().join(pixels.select(F.col("image").alias("_i"), "y").distinct(), F.col("image").eqNullSafe(F.col("_i"))).drop("_i")
    known = pixels.withColumnsRenamed({c: f"_{c}" for c in ("image", "x", "y")})
    same = F.col("image").eqNullSafe(F.col("_image")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    return places.join(known, same, "left").select(*pixels.columns)


def _opened(pixels: DataFrame, paint: str) -> DataFrame:
    """Paint that some block of 2 x 2 painted pixels covers."""
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    beside = F.lead(F.struct("x", paint)).over(row)
    pairs = pixels.withColumn("_pair", F.least(F.col(paint), F.when(beside["x"] == F.col("x") + 1, beside[paint]).otherwise(0)))
    below = F.lead(F.struct("y", "_pair")).over(column)
    blocks = pairs.withColumn("_below", F.when(below["y"] == F.col("y") + 1, below["_pair"]).otherwise(0)).withColumn("_full", F.least("_pair", "_below"))
    # a full block paints its pixel, the next ones to the right and below
    down = blocks.withColumn("_full", F.max("_full").over(column.rangeBetween(-1, 0)))
    return down.withColumn(paint, F.max("_full").over(row.rangeBetween(-1, 0))).select(*pixels.columns)


def paint_mask(pixels: DataFrame, radius: int = 4, keep_pct: float = 8.0, dark_pct: float = 40.0) -> DataFrame:
    """Rows (image, x, y, top_hat, paint): whether a pixel may be road paint.

    Counted are pixels that are not black and, where `pixels` has a column
    `inside`, for which it is true.  Of those at or over their image's percentile
    `dark_pct` of grey, paint are those whose top-hat response (see top_hat) is
    among the highest `keep_pct` percent and at least LEAST; then what no
    block of 2 x 2 such pixels covers goes.  Null grey is no pixel; an image
    without a counted pixel has no paint; repeated pixels are not looked for.
    """
    known = pixels.where("gray is not null and x is not null and y is not null")
    inside = F.coalesce(F.col("inside"), F.lit(False)) if "inside" in pixels.columns else F.lit(True)
    hat = top_hat(known.select("image", "x", "y", "gray", (inside & (F.col("gray") > 0)).alias("_valid")), radius)
    grey = hat.where("_valid").groupBy("image").agg(F.percentile("gray", F.lit(dark_pct / 100.0)).alias("_dark"))
    bright = hat.join(grey, "image", "left").withColumn("_some", F.col("_valid") & (F.col("gray") >= F.col("_dark")))
    level = bright.where("_some").groupBy("image").agg(F.greatest(F.percentile("top_hat", F.lit(1.0 - keep_pct / 100.0)), F.lit(LEAST)).alias("_level"))
    marked = bright.join(level, "image", "left").withColumn("paint", F.coalesce((F.col("_some") & (F.col("top_hat") >= F.col("_level"))).cast("int"), F.lit(0)))
    opened = _opened(marked.select("image", "x", "y", "top_hat", "paint"), "paint")
    return opened.withColumn("paint", F.col("paint") == 1)


def _envelope(y: np.ndarray, square: np.ndarray) -> np.ndarray:
    """min over i of (y - y[i])^2 + square[i], for each y: the lower envelope of parabolas, in one pass."""
    seats, begins = [], []
    for i in np.flatnonzero(np.isfinite(square)).tolist():
        start = -np.inf
        while seats:
            k = seats[-1]
            start = (square[i] + y[i] ** 2 - square[k] - y[k] ** 2) / (2.0 * (y[i] - y[k]))
            if start > begins[-1]:
                break
            seats.pop()
            begins.pop()
            start = -np.inf
        seats.append(i)
        begins.append(start)
    if not seats:
        return np.full(len(y), np.nan)
    at = np.array(seats)[np.searchsorted(begins, y, side="right") - 1]
    return (y - y[at]) ** 2 + square[at]


def distance_field(mask: DataFrame) -> DataFrame:
    """Rows (image, x, y, distance): pixels from each pixel of `mask` (image, x, y, paint) to the nearest paint of its image, exact; null in an image without paint.

    One pass along rows by windows, one along columns by the lower envelope of
    parabolas; a column is one task's.  A null paint is none.
    """
    row = Window.partitionBy("image", "y").orderBy("x")
    at = F.when(F.coalesce("paint", F.lit(False)), F.col("x"))
    left, right = F.last(at, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0)), F.first(at, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    mask = _whole(mask.withColumn("_here", F.lit(True)))
    along = mask.select("image", "x", "y", F.least(F.col("x") - left, right - F.col("x")).cast("double").alias("_along"), "_here")
    kinds = ", ".join(f"{c} {mask.schema[c].dataType.simpleString()}" for c in ("image", "x", "y"))

    def down(column: pd.DataFrame) -> pd.DataFrame:
        column = column.sort_values("y", kind="stable")
        here = column._here.notna().to_numpy()
        near = column._along.to_numpy(float)
        square = _envelope(column.y.to_numpy(float), np.where(np.isnan(near), np.inf, near**2))
        return column[["image", "x", "y"]].assign(distance=np.sqrt(square))[here]

    out = deal(along, "image", "x").groupBy("image", "x").applyInPandas(down, f"{kinds}, distance double")
    return out.withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))

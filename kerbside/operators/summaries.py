"""Camera and track summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import speed_kmh, window

#: A speed above this counts as moving.
MOVING_KMH = 1.0


def camera_summary(detections: DataFrame, cameras: DataFrame) -> DataFrame:
    """Rows (cctv_id, name, n_objects, n_detections, avg_speed_kmh): one for each camera with detections; the mean is over moving objects; a camera without a name is called by its id.

    Cameras are a directory, read once for each site.
    """
    moving = F.avg(F.when(F.col("speed_kmh") > MOVING_KMH, F.col("speed_kmh")))
    counts = detections.groupBy("cctv_id").agg(F.countDistinct("track_id").alias("n_objects"), F.count(F.lit(1)).alias("n_detections"), F.round(moving, 1).alias("avg_speed_kmh"))
    return counts.join(cameras.select("cctv_id", "name"), "cctv_id", "left").select("cctv_id", F.coalesce("name", "cctv_id").alias("name"), "n_objects", "n_detections", "avg_speed_kmh")


def busiest(detections: DataFrame, n: int = 1) -> DataFrame:
    """The n cameras with most distinct tracks, by id on ties: rows (cctv_id, n_objects)."""
    return detections.groupBy("cctv_id").agg(F.countDistinct("track_id").alias("n_objects")).orderBy(F.col("n_objects").desc(), "cctv_id").limit(n)


def objects_by_class(detections: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct tracks by class."""
    count = F.approx_count_distinct("track_id") if approximate else F.countDistinct("track_id")
    return detections.groupBy("class").agg(count.alias("n_objects"))


def fragmentation(rows: DataFrame, fps: float, *, impossible_kmh: float = 180.0, short_s: float = 0.5, by: str = "cctv_id") -> DataFrame:
    """How broken tracks are, for each camera: n_tracks, median_life, p90_life, short_pct, cover_pct, n_impossible, p99_speed.

    Rows have by, track_id, frame, x, y.  cover is the share of a track's span
    of frames in which it is seen.
    """
    w = window([by, "track_id"], ["frame"])
    moved = rows.withColumn("v", speed_kmh(F.col("x"), F.col("y"), F.col("frame") / fps, w))
    lives = moved.groupBy(by, "track_id").agg((F.max("frame") - F.min("frame")).alias("span"), F.countDistinct("frame").alias("seen"))
    life = F.col("span") / fps
    tracks = lives.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_tracks"), F.percentile(life, F.lit(0.5)).alias("median_life"), F.percentile(life, F.lit(0.9)).alias("p90_life"),
        (100.0 * F.avg((life < short_s).cast("double"))).alias("short_pct"), (100.0 * F.sum("seen") / F.sum(F.col("span") + 1)).alias("cover_pct"),
    )
    speeds = moved.where("v is not null").groupBy(by).agg(F.count_if(F.col("v") > impossible_kmh).alias("n_impossible"), F.percentile("v", F.lit(0.99)).alias("p99_speed"))
    return tracks.join(speeds, by, "left").withColumn("n_impossible", F.coalesce("n_impossible", F.lit(0)))


def shift_stats(rows: DataFrame, shift: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, median, 95th percentile and maximum of a shift."""
    return rows.groupBy(*(by or [])).agg(F.count(shift).alias("n"), F.avg(shift).alias("mean"), F.percentile(shift, F.lit(0.5)).alias("median"), F.percentile(shift, F.lit(0.95)).alias("p95"), F.max(shift).alias("max"))


def match_metrics(states: DataFrame, fps: float, least_s: float = 0.2, by: str = "cctv_id") -> DataFrame:
    """Quality of matched tracks (by, track_id, frame, link_id, heading, d): link changes a second over tracks longer than `least_s`, heading change median and 90th percentile, median distance from the lane."""
    w = window([by, "track_id"], ["frame"])
    turned = F.abs(F.col("heading") - F.lag("heading").over(w))
    steps = states.withColumn("changed", (F.lag("link_id").over(w) != F.col("link_id")).cast("int")).withColumn("dh", F.abs(turned - 360.0 * F.floor((turned + 180.0) / 360.0)))
    per = steps.groupBy(by, "track_id").agg(F.sum("changed").alias("changes"), ((F.max("frame") - F.min("frame")) / fps).alias("span"))
    flicker = per.where(F.col("span") > least_s).groupBy(by).agg((F.sum("changes") / F.sum("span")).alias("flicker_per_s"))
    rest = steps.groupBy(by).agg(F.percentile("dh", F.lit(0.5)).alias("heading_median"), F.percentile("dh", F.lit(0.9)).alias("heading_p90"), F.percentile(F.abs("d"), F.lit(0.5)).alias("lateral_median"))
    return rest.join(flicker, by, "left")


def upsert_latest(rows: DataFrame, key: list[str], newest: list) -> DataFrame:
    """One row for each key: the first in the order `newest`."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).where("_r = 1").drop("_r")

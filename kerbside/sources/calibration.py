"""Camera calibrations, control points, dimension priors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CALIBRATION

# What a calibration has where its file says nothing.
DEFAULTS = {"use_roi": False, "roi_method": "partial", "ref_method": "center_bottom_side", "proj_method": "down_h"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file, with defaults for missing settings."""
    rows = spark.read.schema(CALIBRATION).option("multiLine", True).json(path)
    return rows.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in DEFAULTS.items()})


def flat(calibrations: DataFrame) -> DataFrame:
    """Matrices as columns h00..h22 and k00..k22, parallax and origin as columns: what projection needs."""
    cells = [(f"{m}{r}{c}", F.col(path)[r][c]) for m, path in (("h", "homography.H"), ("k", "undistort.K")) for r in range(3) for c in range(3)]
    return calibrations.select(
        F.col("meta.location_code").alias("cctv_id"), *(v.alias(k) for k, v in cells), F.col("undistort.D").alias("d"),
        F.coalesce("parallax.x_cam_coords_sat", F.lit(0.0)).alias("cam_x"), F.coalesce("parallax.y_cam_coords_sat", F.lit(0.0)).alias("cam_y"), F.coalesce("parallax.z_cam_meters", F.lit(0.0)).alias("cam_z"),
        F.col("world.epsg").alias("epsg"), F.col("world.origin_easting").alias("origin_easting"), F.col("world.origin_northing").alias("origin_northing"),
    )


def anchors(calibrations: DataFrame) -> DataFrame:
    """One row for each control point: cctv_id, n, u, v, lon, lat."""
    each = calibrations.select(F.col("meta.location_code").alias("cctv_id"), F.posexplode("homography.anchors_list").alias("n", "a"))
    return each.select("cctv_id", "n", F.col("a.px")[0].alias("u"), F.col("a.px")[1].alias("v"), F.col("a.lonlat")[0].alias("lon"), F.col("a.lonlat")[1].alias("lat"))


def priors(spark: SparkSession, path: str) -> DataFrame:
    """Rows (set, class, width, length, height); entries that are no sets of dimensions are skipped."""
    text = spark.read.text(path, wholetext=True)
    sets = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("set", "body"))
    each = sets.select("set", F.explode(F.from_json("body", "map<string,struct<width:double,length:double,height:double>>", {"mode": "PERMISSIVE"})).alias("class", "d"))
    return each.where("d.width is not null").select("set", F.lower(F.trim("class")).alias("class"), "d.width", "d.length", "d.height")


def with_dimensions(rows: DataFrame, dimensions: DataFrame, missing_height: float = 0.0) -> DataFrame:
    """`rows` with width, length, height by class, ignoring case; no box and `missing_height` where there is no prior.

    The dimensions of one set are a fixed list of vehicle classes.
    """
    small = dimensions.select(F.lower(F.trim("class")).alias("_class"), "width", "length", "height").dropDuplicates(["_class"])
    out = rows.join(small, F.lower(F.trim(rows["class"])) == F.col("_class"), "left").drop("_class")
    return out.withColumn("have_measurements", F.col("height").isNotNull()).withColumn("height", F.coalesce("height", F.lit(missing_height)))

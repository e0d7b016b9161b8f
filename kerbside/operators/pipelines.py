"""Whole jobs over replay objects, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, geometry
from ..sources.calibration import with_dimensions
from . import smoother, tracking
from .lane_graph import Graph

MAX_RANGE_M, MAX_SIGMA_M, DEFAULT_HEIGHT_M = 250.0, 25.0, 1.55
_H = [f"h{r}{c}" for r in range(3) for c in range(3)]


def place(objects: DataFrame, calibrations: DataFrame, dimensions: DataFrame, missing_height: float = 0.0, sigma_px: float = 3.0) -> DataFrame:
    """`objects` (cctv_id, class, bbox_2d, ...) with ground point x, y, its covariance c_xx, c_xy, c_yy, and dimensions.

    calibrations has one flat row for each camera.
    """
    rows = with_dimensions(objects.drop("width", "length", "height"), dimensions, missing_height).join(calibrations, "cctv_id")
    box = tuple(F.col("bbox_2d")[k] for k in range(4))
    h = [F.col(c) for c in _H]
    x, y = geometry.contact_point(box, F.col("height"), h, F.col("cam_x"), F.col("cam_y"), F.col("cam_z"))
    placed = geometry.with_ground_covariance(rows, h, (box[0] + box[2]) / 2.0, box[3], F.col("height"), F.col("cam_x"), F.col("cam_y"), F.col("cam_z"), sigma_px)
    return placed.withColumns({"x": x, "y": y})


def reject_far(rows: DataFrame, most_range: float = MAX_RANGE_M, most_sigma: float = MAX_SIGMA_M) -> DataFrame:
    """Ground points too far from the camera, too uncertain or not finite become null; proj_rejected says so."""
    far = F.hypot(F.col("x") - F.col("cam_x"), F.col("y") - F.col("cam_y")) > most_range
    wide = geometry.largest_sigma(F.col("c_xx"), F.col("c_xy"), F.col("c_yy")) > most_sigma
    bad = F.coalesce(far | wide | F.isnan("x") | F.isnan("y"), F.lit(True))
    return rows.withColumns({"proj_rejected": bad, "x": F.when(~bad, F.col("x")), "y": F.when(~bad, F.col("y"))})


def with_box(rows: DataFrame) -> DataFrame:
    """Floor box of objects that have a heading and dimensions."""
    ready = F.col("heading").isNotNull() & F.col("length").isNotNull() & F.col("x").isNotNull()
    return rows.withColumn("sat_floor_box", F.when(ready, geometry.floor_box(F.col("x"), F.col("y"), F.col("heading"), F.col("length"), F.col("width"))))


def reproject(objects: DataFrame, calibrations: DataFrame, dimensions: DataFrame, fps: float, settings: smoother.Settings | None = None) -> DataFrame:
    """All that follows from boxes anew: ground points, speeds and headings by track, floor boxes.  Objects without a track or a ground point keep nulls."""
    placed = reject_far(place(objects, calibrations, dimensions))
    plain = placed.drop("heading", "speed_kmh", "meta")
    return with_box(smoother.smooth(plain, ["cctv_id", "tracked_id"], fps, settings))


def retrack(objects: DataFrame, calibrations: DataFrame, dimensions: DataFrame, fps: float, settings: tracking.Settings | None = None, graph: Graph | None = None) -> DataFrame:
    """Objects tracked anew on the ground (track_id), then smoothed and boxed."""
    placed = reject_far(place(objects, calibrations, dimensions, DEFAULT_HEIGHT_M))
    tracked = tracking.track(placed.drop("track_id", "heading", "speed_kmh"), fps, settings, graph)
    return with_box(smoother.smooth(tracked, ["cctv_id", "track_id"], fps))


def to_detections(rows: DataFrame, calibrations: DataFrame, zone: int, fps: float) -> DataFrame:
    """Placed objects as rows of the detection table: time, map coordinates and degrees."""
    from ..sources.replay import time_of

    origin = calibrations.select("cctv_id", F.col("origin_easting").alias("_e"), F.col("origin_northing").alias("_n"))
    e, n = geodesy.local_to_utm(F.col("x"), F.col("y"), F.col("_e"), F.col("_n"))
    out = rows.where("x is not null and y is not null").join(origin, "cctv_id").withColumn("easting", e).withColumn("northing", n)
    lon, lat = geodesy.from_utm(F.col("easting"), F.col("northing"), zone)
    return out.select(time_of(F.col("frame"), F.lit(fps)).alias("ts"), "frame", "cctv_id", F.col("tracked_id").alias("track_id"), "class", "confidence", "speed_kmh", F.col("heading").alias("heading_deg"), lon.alias("lon"), lat.alias("lat"), "easting", "northing")


def guide(points: DataFrame, guidelines: DataFrame, key: str = "row_id") -> DataFrame:
    """`points` (key, cctv_id, x, y) with the heading of the nearest of the camera's guidelines (cctv_id, x1, y1, x2, y2, heading_deg), by squared distance to its middle."""
    g = guidelines.select("cctv_id", ((F.col("x1") + F.col("x2")) / 2.0).alias("_gx"), ((F.col("y1") + F.col("y2")) / 2.0).alias("_gy"), F.col("heading_deg").alias("_gh"))
    d = (F.col("x") - F.col("_gx")) * (F.col("x") - F.col("_gx")) + (F.col("y") - F.col("_gy")) * (F.col("y") - F.col("_gy"))
    # a camera has a few guidelines
    near = points.join(g, "cctv_id").groupBy(key).agg(F.min_by("_gh", F.struct(d, "_gh")).alias("guide"))
    return points.join(near, key, "left")


def round_coordinates(points: DataFrame, column: str = "coordinates", digits: int = 7) -> DataFrame:
    """Coordinates array<array<double>> without heights, rounded half to even."""
    return points.withColumn(column, F.transform(column, lambda p: F.transform(F.slice(p, 1, 2), lambda v: F.bround(v, digits))))


def tiles_of(spark: SparkSession, box: tuple[float, float, float, float], zoom: int, most: int = 1200) -> DataFrame:
    """Rows (z, x, y, left, top): the tiles that cover (west, south, east, north) and where each goes in a mosaic, in pixels; more than `most` are an error."""
    one = spark.range(1).select(*geodesy.tile(F.lit(box[0]), F.lit(box[3]), zoom), *geodesy.tile(F.lit(box[2]), F.lit(box[1]), zoom)).first()
    x0, y0, x1, y1 = (int(v) for v in one)
    wide, high = x1 - x0 + 1, y1 - y0 + 1
    if wide * high > most:
        raise ValueError(f"{wide * high} tiles; take a smaller zoom or box")
    i, j = (F.col("id") % wide).cast("int"), F.floor(F.col("id") / wide).cast("int")
    return spark.range(wide * high).select(F.lit(zoom).alias("z"), (i + x0).alias("x"), (j + y0).alias("y"), (i * 256).alias("left"), (j * 256).alias("top"))


def cached_tiles(tiles: DataFrame, get, path: str, least_bytes: int = 100) -> DataFrame:
    """As `fetch_tiles`, keeping answers of `least_bytes` or more in a table at `path`, from which tiles seen before are taken."""
    from ..sinks import exists

    spark = tiles.sparkSession
    key = ["z", "x", "y"]
    known = spark.read.parquet(path) if exists(spark, path) else None
    todo = tiles.select(*key) if known is None else tiles.select(*key).join(known.select(*key), key, "left_anti")
    fetch_tiles(todo, get).where(F.octet_length("content") >= least_bytes).write.mode("append").parquet(path)
    return tiles.join(spark.read.schema("z int, x int, y int, content binary").parquet(path), key, "left")


def fetch_tiles(tiles: DataFrame, get) -> DataFrame:
    """Rows (z, x, y, content) for tiles (z, x, y): `get(z, x, y)` is the caller's way to the bytes; a tile that fails has null."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for key in zip(*(batch.column(c).to_pylist() for c in ("z", "x", "y")), strict=True):
                try:
                    out.append(get(*key))
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(pa.int32()) for c in ("z", "x", "y")] + [pa.array(out, pa.binary())], names=["z", "x", "y", "content"])

    return tiles.select("z", "x", "y").mapInArrow(run, "z int, x int, y int, content binary")

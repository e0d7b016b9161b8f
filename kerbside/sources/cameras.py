"""Camera directories: saved service responses, tables, and URLs."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geodesy import flat_distance

# Fixed value: the name space of sheets.
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RESPONSE = "response struct<data:array<struct<coordx:string,coordy:string,cctvtype:string,cctvformat:string,cctvname:string,cctvurl:string>>>"


def within(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point is in (west, south, east, north), borders included."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def read_response(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, need_url: bool = False) -> DataFrame:
    """Cameras of saved responses; rows whose coordinates are no numbers are skipped."""
    rows = spark.read.schema(RESPONSE).option("multiLine", True).json(path).select(F.explode("response.data").alias("c")).select("c.*")
    lon, lat = F.expr("try_cast(coordx as double)"), F.expr("try_cast(coordy as double)")
    out = rows.select(F.col("cctvname").alias("name"), lon.alias("lon"), lat.alias("lat"), F.col("cctvtype").alias("kind"), F.col("cctvformat").alias("format"), F.col("cctvurl").alias("url")).where("lon is not null and lat is not null")
    if box:
        out = out.where(within(F.col("lon"), F.col("lat"), box))
    return out.where("url is not null and url <> ''") if need_url else out


def with_streams(cameras: DataFrame, streams: DataFrame, key: str = "cam_id", limit: int | None = None) -> DataFrame:
    """Cameras joined with their stream addresses in one join, by key; the first `limit` by key if given (a report's size)."""
    few = cameras.orderBy(key).limit(limit) if limit else cameras
    return few.join(streams, key)


def stream_url(endpoint: str, key: str, camera: Column, name: Column, kind: Column) -> Column:
    """Address of a camera's stream from its parts, each percent-encoded."""
    parts = [("key", F.lit(key)), ("cctvid", camera), ("cctvName", name), ("kind", kind)]
    query = F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in parts))
    return F.concat(F.lit(f"{endpoint}?"), query)


def read_table(rows: DataFrame, box: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows of a camera table in the area of interest."""
    return rows.where(within(F.col(lon).cast("double"), F.col(lat).cast("double"), box))


def read_workbook(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """Rows (path, row, cells array<string>) of a sheet of .xlsx files, one task for each file; cells that a row skips are null."""

    def column(name: str) -> int:
        n = 0
        for c in name:
            if not c.isalpha():
                break
            n = n * 26 + ord(c) - 64
        return n - 1

    def text(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_SHEET}t"))

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                out = []
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    shared = [text(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in z.namelist() else []
                    for row in ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{_SHEET}row"):
                        cells: list[str | None] = []
                        for c in row.iter(f"{_SHEET}c"):
                            value = c.find(f"{_SHEET}v")
                            said = text(c) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                            at = column(c.get("r", "")) if c.get("r") else len(cells)
                            cells += [None] * (at + 1 - len(cells))
                            cells[at] = said
                        out.append((int(row.get("r", len(out) + 1)), cells))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), pa.array([r for r, _ in out], pa.int32()), pa.array([c for _, c in out], pa.list_(pa.string()))], names=["path", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row int, cells array<string>")


def workbook_table(rows: DataFrame) -> DataFrame:
    """The sheet of `read_workbook` as a table: the first row of the first file names the columns, in all files."""
    names = [(n or f"_{k}").strip() for k, n in enumerate(rows.where("row = 1").orderBy("path").limit(1).first().cells)]
    return rows.where("row > 1").select(*(F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)))


def nearest_to(cameras: DataFrame, lon: float, lat: float, n: int, start: int = 0, key: str = "cctv_id") -> DataFrame:
    """The cameras number start..start+n-1 by distance from a place; equal distances by key."""
    d = flat_distance(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))
    return cameras.withColumn("metres", d).orderBy("metres", key).offset(start).limit(n)


def upsert(known: DataFrame, feature: DataFrame, metres: float = 250.0) -> DataFrame:
    """A directory with `feature` (one row: cctv_id, name, lon, lat, has_replay): rows of the same id or name go, as do those nearer than `metres` without a replay."""
    one = feature.select(F.col("cctv_id").alias("_id"), F.col("name").alias("_name"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    near = flat_distance(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")) < metres
    same = (F.col("cctv_id") == F.col("_id")) | F.coalesce(F.col("name") == F.col("_name"), F.lit(False)) | (near & ~F.coalesce("has_replay", F.lit(False)))
    return known.join(F.broadcast(one), same, "left_anti").unionByName(feature, allowMissingColumns=True)


def refresh(known: DataFrame, found: DataFrame, metres: float = 250.0) -> DataFrame:
    """Rows with a replay stay; new ones come in unless one of those has their name or is nearer than `metres`.

    Cameras meet in square cells of at least `metres`, so that no pair farther
    than a neighbouring cell is compared.
    """
    from ..operators.spatial_join import without_neighbours

    keep = known.where("has_replay")
    names = keep.select("name").where("name is not null").distinct()
    fresh = found.join(names, "name", "left_anti").withColumn("x", F.col("lon") * 88800.0).withColumn("y", F.col("lat") * 111000.0)
    placed = keep.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).withColumn("x", F.col("_lon") * 88800.0).withColumn("y", F.col("_lat") * 111000.0)
    return keep.unionByName(without_neighbours(fresh, placed, "cctv_id", metres).drop("x", "y"), allowMissingColumns=True)


def unique_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null key all stay."""
    known = rows.where(" and ".join(f"{k} is not null" for k in keys))
    rest = rows.where(" or ".join(f"{k} is null" for k in keys))
    first = Window.partitionBy(*keys).orderBy(*order)
    return known.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").unionByName(rest)

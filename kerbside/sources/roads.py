"""Road maps: shapefiles, GeoJSON exports, and way lists of a street map service."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geodesy import to_utm
from .cameras import within

#: GeoJSON features; properties stay text for each layer to read.
FEATURES = "type string, features array<struct<layer:string,id:string,type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature: layer, id, properties, kind, coordinates as JSON text."""
    rows = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    layer = F.coalesce("f.layer", F.col("f.properties")["layer"])
    ident = F.coalesce("f.id", F.col("f.properties")["id"])
    return rows.select(layer.alias("layer"), ident.alias("id"), F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def lines(features: DataFrame, layer: str, zone: int, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Line features of a layer as links in local metres; those of fewer than two points go."""
    own = features.where((F.col("layer") == layer) & (F.col("kind") == "LineString")).withColumn("c", F.from_json("coordinates", "array<array<double>>")).where("size(c) >= 2")

    def metres(p):
        e, n = to_utm(p[0], p[1], zone)
        return F.struct((e - origin[0]).alias("x"), (n - origin[1]).alias("y"))

    p = F.col("properties")
    return own.select(F.col("id").alias("link_id"), F.transform("c", metres).alias("pts"), F.lit(True).alias("directed"), F.expr("try_cast(properties['lane_no'] as int)").alias("lane_no"), p["from_node"].alias("from_node"), p["to_node"].alias("to_node"))


def ways(spark: SparkSession, path: str, zone: int, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Links from a saved street map response: ways with geometry; one-way ones are directed."""
    schema = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("w")).where("w.type = 'way' and size(w.geometry) >= 2")

    def metres(p):
        e, n = to_utm(p["lon"], p["lat"], zone)
        return F.struct((e - origin[0]).alias("x"), (n - origin[1]).alias("y"))

    one_way = F.coalesce(F.lower(F.col("w.tags")["oneway"]).isin("yes", "true", "1"), F.lit(False))
    return rows.select(F.col("w.id").cast("string").alias("link_id"), F.transform("w.geometry", metres).alias("pts"), one_way.alias("directed"), F.lit(None).cast("int").alias("lane_no"), F.lit(None).cast("string").alias("from_node"), F.lit(None).cast("string").alias("to_node"))


def first_answer(urls: list[str], get: Callable[[str], str]) -> str:
    """The first mirror's answer; `get` is the caller's way to the network."""
    errors = []
    for url in urls:
        try:
            return get(url)
        except OSError as e:
            errors.append(f"{url}: {e}")
    raise OSError("; ".join(errors))


def prefer(sections: DataFrame, section: str = "section", rank: str = "rank") -> DataFrame:
    """One variant of each section: the least rank, then path."""
    best = Window.partitionBy(section).orderBy(rank, "path")
    return sections.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def overlapping(bounds: DataFrame, targets: DataFrame, margin: float) -> DataFrame:
    """Rows of bounds (west, south, east, north) whose inflated box holds a target (lon, lat); targets are a short list of places, more than 100,000 are an error."""
    if targets.limit(100_001).count() > 100_000:
        raise ValueError("too many places to go to every task")
    t = targets.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    inside = within(F.col("_lon"), F.col("_lat"), (F.col("west") - margin, F.col("south") - margin, F.col("east") + margin, F.col("north") + margin))
    return bounds.join(F.broadcast(t), inside, "left_semi")


# ---- shapefiles ----

# Shape types, with Z and M variants, by what they hold.
_POINT, _LINE, _POLYGON = (1, 11, 21), (3, 13, 23), (5, 15, 25)


def header(data: bytes) -> tuple[int, tuple[float, float, float, float]]:
    """(shape type, (west, south, east, north)) from the first hundred bytes of a .shp file."""
    if struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    return struct.unpack("<i", data[32:36])[0], struct.unpack("<4d", data[36:68])


def shapes(data: bytes) -> Iterator[tuple[str | None, list]]:
    """(kind, coordinates) of each record of a .shp file; (None, []) for null shapes."""
    at = 100
    while at + 8 <= len(data):
        words = struct.unpack(">i", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + words * 2]
        at += 8 + words * 2
        kind = struct.unpack("<i", body[:4])[0]
        if kind in _POINT:
            yield "Point", list(struct.unpack("<2d", body[4:20]))
        elif kind in _LINE + _POLYGON:
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            rings = [[[flat[2 * i], flat[2 * i + 1]] for i in range(a, b)] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            if kind in _POLYGON:
                yield "Polygon", rings
            else:
                yield ("LineString", rings[0]) if parts == 1 else ("MultiLineString", rings)
        else:
            yield None, []


def records(data: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str | None]]:
    """Attributes of each record of a .dbf file, as trimmed text; blank ones are null."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii"), data[at + 16]))
        at += 32
    for k in range(n):
        row, place, out = data[head + k * size : head + (k + 1) * size], 1, {}
        for name, width in fields:
            out[name] = row[place : place + width].decode(encoding, "replace").strip() or None
            place += width
        yield out


def read_shapefiles(spark: SparkSession, path: str, columns: dict[str, str], encoding: str = "utf-8") -> DataFrame:
    """Features of all .shp files with their .dbf: path, kind, coordinates (JSON), and the chosen attributes under new names.

    Files pair by path without suffix; only the chosen attributes are kept.
    """
    import json

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(path).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("stem"), F.element_at(F.split("path", r"\."), -1).alias("part"), "content")
    pairs = files.groupBy("stem").agg(F.max(F.when(F.col("part") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("part") == "dbf", F.col("content"))).alias("dbf")).where("shp is not null")
    names = list(columns.values())

    def run(batches):
        for batch in batches:
            for stem, shp, dbf in zip(*(batch.column(c).to_pylist() for c in ("stem", "shp", "dbf")), strict=True):
                rows = records(dbf, encoding) if dbf else None
                out = [[], [], [], *([] for _ in names)]
                for kind, coordinates in shapes(shp):
                    row = next(rows, {}) if rows else {}
                    if kind:
                        for column, value in zip(out, [stem, kind, json.dumps(coordinates), *(row.get(k) for k in columns)], strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["path", "kind", "coordinates", *names])

    return pairs.mapInArrow(run, ", ".join(f"`{c}` string" for c in ["path", "kind", "coordinates", *names]))


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """path, shape type and bounds of .shp files, from their headers."""

    def run(batches):
        for batch in batches:
            heads = [header(b) for b in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([k for k, _ in heads], pa.int32()), *(pa.array([b[i] for _, b in heads], pa.float64()) for i in range(4))], names=["path", "shape", "west", "south", "east", "north"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path", F.substring("content", 1, 100).alias("content"))
    return raw.mapInArrow(run, "path string, shape int, west double, south double, east double, north double")


class WaysSource(DataSource):
    """`spark.read.format("street_ways")`: saved street map responses as rows (id, oneway, points), one task for each file."""

    @classmethod
    def name(cls) -> str:
        return "street_ways"

    def schema(self) -> str:
        return "id bigint, oneway boolean, points array<array<double>>"

    def reader(self, schema) -> DataSourceReader:
        return _WaysReader([p for p in self.options.get("path", "").split(",") if p])


class _WaysReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        import json

        with open(partition.value, encoding="utf-8") as f:
            for e in json.load(f).get("elements", []):
                if e.get("type") == "way" and len(e.get("geometry", [])) >= 2:
                    yield e["id"], str(e.get("tags", {}).get("oneway", "")).lower() in ("yes", "true", "1"), [[p["lon"], p["lat"]] for p in e["geometry"]]

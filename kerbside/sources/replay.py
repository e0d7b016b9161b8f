"""Replay documents: one nested JSON for each clip, gzipped or plain."""

from __future__ import annotations

import gzip
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BASE_TIME, REPLAY

# Parts of file names that mark a document as derived from another.
DERIVED = ("reprojected", "lanesnap", "retrack", "mapmatch")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents with `path`; the codec follows the suffix.

    A gzip file is one task; convert large collections once with
    :func:`objects` and a Parquet sink partitioned by camera.
    """
    return spark.read.schema(REPLAY).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def read_by_content(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read`, with the codec by the file's first bytes, for files with a wrong suffix."""

    def run(batches):
        for batch in batches:
            texts = [gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b for b in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([t.decode("utf-8") for t in texts], pa.string())], names=["path", "text"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")
    return raw.select("path", F.from_json("text", REPLAY).alias("d")).select("d.*", "path")


def frames(documents: DataFrame) -> DataFrame:
    """One row for each frame, empty ones included: location_code, frame, n_objects."""
    return documents.select("location_code", F.explode("frames").alias("f")).select("location_code", F.col("f.frame_index").alias("frame"), F.coalesce(F.size("f.objects"), F.lit(0)).alias("n_objects"))


def objects(documents: DataFrame, located: bool = True) -> DataFrame:
    """One row for each object, with frame, fps and origin; without those that have no ground point if `located`."""
    each = documents.select(F.col("location_code").alias("cctv_id"), F.col("meta.fps").alias("fps"), "meta.world", F.explode("frames").alias("f"))
    out = each.select("cctv_id", "fps", "world", F.col("f.frame_index").alias("frame"), F.explode("f.objects").alias("o")).select("cctv_id", "fps", "world", "frame", "o.*")
    return out.where(F.col("sat_coords").isNotNull()) if located else out


def time_of(frame: Column, fps: Column, base: str = BASE_TIME) -> Column:
    """Timestamp of a frame."""
    return F.timestamp_micros(F.unix_micros(F.lit(base).cast("timestamp")) + F.round(frame / fps * 1e6).cast("long"))


def nest(rows: DataFrame, key: str, frame: str, columns: list[str]) -> DataFrame:
    """The way back: rows (key, frames array<struct<frame_index, objects>>), frames and objects in order."""
    per = rows.groupBy(key, frame).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("objects"))
    return per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("frame_index"), "objects"))).alias("frames"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified of files, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def newest(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The newest file (of each group)."""
    return files.groupBy(*(by or [])).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def largest_original(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The largest file (of each group) that is not derived from another."""
    own = files.where(~F.col("path").rlike("|".join(DERIVED)))
    return own.groupBy(*(by or [])).agg(F.max_by("path", F.struct("length", "path")).alias("path"))


def choose(files: DataFrame, camera: str = "cctv_id") -> DataFrame:
    """One source for each camera: published before own output, reprojected before others, then the largest."""
    rank = Window.partitionBy(camera).orderBy(F.col("published").desc(), F.col("path").contains("reprojected").desc(), F.col("length").desc(), "path")
    return files.withColumn("r", F.row_number().over(rank)).where("r = 1").drop("r")


def write(rows: DataFrame, path: str) -> None:
    """Documents as gzipped JSON, one in each file, as `read` takes a file for one document."""
    rows.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", 1).json(path)


def parse(text: str) -> dict:
    """One document from text, for tests and small tools."""
    return json.loads(text)

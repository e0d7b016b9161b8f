"""Detection data sets and ground truth: XML, CSV, zipped annotations, label files."""

from __future__ import annotations

import io
import json
import os
import re
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import LABELS

BOX = "image string, class string, x1 double, y1 double, x2 double, y2 double"


def config(path: str, env: str | None = None) -> dict[str, str]:
    """A JSON configuration, with values of an optional KEY=VALUE file and of the process's environment for what it lacks."""
    with open(path, encoding="utf-8") as f:
        out = json.load(f)
    if env and os.path.exists(env):
        with open(env, encoding="utf-8") as f:
            for line in f:
                if (m := re.match(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line)) and m[1] not in out:
                    out[m[1]] = m[2].strip("'\"")
    return out


def read_xml_frames(spark: SparkSession, path: str, stride: int = 1) -> tuple[DataFrame, DataFrame]:
    """(boxes, ignored regions) of sequence files with one `frame` element for each frame; every `stride`-th frame."""
    target = "struct<_id:int,box:struct<_left:double,_top:double,_width:double,_height:double>,attribute:struct<_vehicle_type:string>>"
    frames = spark.read.format("xml").option("rowTag", "frame").schema(f"_num int, target_list struct<target:array<{target}>>").load(path).withColumn("sequence", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.xml$", 1))
    kept = frames.where(F.pmod(F.col("_num") - 1, F.lit(stride)) == 0)
    each = kept.select("sequence", F.col("_num").alias("frame"), F.explode("target_list.target").alias("t"))
    boxes = each.select("sequence", "frame", F.col("t._id").alias("track_id"), F.col("t.attribute._vehicle_type").alias("class"), *_corners(F.col("t.box")))
    region = spark.read.format("xml").option("rowTag", "ignored_region").schema("box array<struct<_left:double,_top:double,_width:double,_height:double>>").load(path)
    regions = region.withColumn("sequence", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.xml$", 1)).select("sequence", F.explode("box").alias("b")).select("sequence", *_corners(F.col("b")))
    return boxes, regions


def _corners(b: Column) -> list[Column]:
    return [b["_left"].alias("x1"), b["_top"].alias("y1"), (b["_left"] + b["_width"]).alias("x2"), (b["_top"] + b["_height"]).alias("y2")]


def outside(boxes: DataFrame, regions: DataFrame, by: str) -> DataFrame:
    """Boxes whose centre is in no region of their group."""
    r = regions.select(F.col(by).alias("_by"), *(F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")))
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    return boxes.join(r, (boxes[by] == F.col("_by")) & cx.between(F.col("_x1"), F.col("_x2")) & cy.between(F.col("_y1"), F.col("_y2")), "left_anti")


def read_csv_boxes(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """Boxes of a CSV without header (image, class, x1, y1, x2, y2); a header line and lines that are no boxes are skipped; of every `stride`-th image by name."""
    rows = spark.read.schema(BOX).option("mode", "PERMISSIVE").csv(path).where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    return every(rows, "image", stride)


def every(rows: DataFrame, key: str, stride: int) -> DataFrame:
    """Rows of the keys number 0, stride, 2 * stride ... in order.

    Keys are numbered over ranges of keys, each counted on its own, so that no
    task sees all of them.
    """
    if stride <= 1:
        return rows
    keys = rows.select(F.col(key).alias("_key")).distinct()
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id())
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("_key")))
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    chosen = local.join(F.broadcast(before), "_part").where(F.pmod(F.col("_before") + F.col("_n") - 1, F.lit(stride)) == 0).select("_key")
    return rows.join(chosen, rows[key] == F.col("_key"), "left_semi")


def read_zipped(spark: SparkSession, labels: str, images: str) -> DataFrame:
    """Boxes of annotation XML in zip files, joined with the images of other zip files by folder name and file name.

    An image belongs to an annotation if one of the folders above it has the
    annotation's name.
    """
    fields = "clip string, image string, class string, x1 double, y1 double, x2 double, y2 double"

    def boxes(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = []
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        if name.lower().endswith(".xml"):
                            clip = os.path.splitext(os.path.basename(name))[0]
                            for image in ET.fromstring(z.read(name)).iter("image"):
                                rows += [(clip, os.path.basename(image.get("name", "")), b.get("label"), *(float(b.get(k, "nan")) for k in ("xtl", "ytl", "xbr", "ybr"))) for b in image.iter("box")]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 3 else pa.float64()) for k, c in enumerate(columns)], names=["clip", "image", "class", "x1", "y1", "x2", "y2"])

    def members(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [n for n in z.namelist() if re.search(r"\.(jpe?g|png)$", n, re.I)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(names, pa.string())], names=["archive", "member"])

    def zips(path: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    found = zips(images).mapInArrow(members, "archive string, member string")
    folders = found.select("archive", "member", F.element_at(F.split("member", "/"), -1).alias("image"), F.explode(F.split("member", "/")).alias("clip"))
    return zips(labels).mapInArrow(boxes, fields).join(folders, ["clip", "image"])


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(boxes, labelled frames) of label files: loc, frame, track_id, class, x1..y2; loc, frame."""
    rows = spark.read.schema(LABELS).option("multiLine", True).json(path)
    boxes = rows.select("loc", F.explode("boxes").alias("b")).select("loc", "b.frame", "b.track_id", "b.class", *(F.col("b.bbox")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))
    return boxes, rows.select("loc", F.explode("frames").alias("f")).select("loc", F.col("f.index").alias("frame"))


def centre_in(box: tuple[Column, Column, Column, Column], roi: tuple[float, float, float, float]) -> Column:
    """Whether a box's centre is in a region, borders included."""
    x, y = (box[0] + box[2]) / 2.0, (box[1] + box[3]) / 2.0
    return x.between(roi[0], roi[2]) & y.between(roi[1], roi[3])


def predictions(objects: DataFrame, frames: DataFrame, roi: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Objects of labelled frames alone, in the region if one is given."""
    some = objects.join(frames.select("frame").distinct(), "frame", "left_semi")
    return some.where(centre_in(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), roi)) if roi else some


def sequence_frames(total: int, n: int, mode: str = "seq", start: int = 0, stride: int = 3) -> list[int]:
    """Frame numbers to look at: `seq` from start by stride, `even` spread over the clip; n at most."""
    if mode == "even":
        return list(range(0, total, max(1, total // n)))[:n]
    return [start + i * stride for i in range(n) if start + i * stride < total]

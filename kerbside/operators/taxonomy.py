"""Class taxonomies and data set building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Targets with a meaning of their own.
DROP, CONFLICT = "__drop__", "__conflict__"


def unknown(values: DataFrame, names: DataFrame, column: str = "class") -> DataFrame:
    """Values that no name matches."""
    return values.select(column).distinct().join(names.select(column).distinct(), column, "left_anti")


def remap(rows: DataFrame, mapping: DataFrame, column: str = "class", strict: bool = True) -> DataFrame:
    """`rows` with `target`; classes that map to DROP go.

    A class without an entry, or one that maps to CONFLICT, raises an error when
    the rows are read; with strict=False it goes as well.  mapping (class,
    target) is a fixed list.
    """
    m = mapping.select(F.col("class").alias("_class"), F.col("target").alias("_target"))
    found = rows.join(m, rows[column] == F.col("_class"), "left").drop("_class")
    bad = F.col("_target").isNull() | (F.col("_target") == CONFLICT)
    target = F.when(bad, F.raise_error(F.concat(F.lit("class without a target: "), F.coalesce(F.col(column), F.lit("null"))))).otherwise(F.col("_target")) if strict else F.when(~bad, F.col("_target"))
    out = found.withColumn("target", target).drop("_target")
    return out.where(F.col("target") != DROP)


def clip(box: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """A box cut to the image."""
    z = F.lit(0.0)
    return F.greatest(z, F.least(width, box[0])), F.greatest(z, F.least(height, box[1])), F.greatest(z, F.least(width, box[2])), F.greatest(z, F.least(height, box[3]))


def valid(box: tuple[Column, ...], least: float = 3.0) -> Column:
    """Whether both sides have `least` pixels."""
    return ((box[2] - box[0]) >= least) & ((box[3] - box[1]) >= least)


def label_line(number: Column, box: tuple[Column, ...], width: Column, height: Column) -> Column:
    """`class cx cy w h`, as shares of the image with six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", number.cast("int"), (box[0] + box[2]) / 2.0 / width, (box[1] + box[3]) / 2.0 / height, (box[2] - box[0]) / width, (box[3] - box[1]) / height)


def label_files(images: DataFrame, boxes: DataFrame, classes: list[str]) -> DataFrame:
    """Rows (image, text, n): the label text of every image (image, width, height), empty where it has no valid box (image, target, x1..y2)."""
    numbers = F.create_map(*(x for k, c in enumerate(classes) for x in (F.lit(c), F.lit(k))))
    joined = boxes.join(images, "image")
    cut = clip(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("width").cast("double"), F.col("height").cast("double"))
    good = joined.select("image", "target", "width", "height", *(v.alias(n) for v, n in zip(cut, ("a", "b", "c", "d"), strict=True)))
    box = tuple(F.col(c) for c in "abcd")
    lines = good.where(valid(box)).select("image", label_line(numbers[F.col("target")], box, F.col("width"), F.col("height")).alias("line"))
    files = lines.groupBy("image").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return images.select("image").join(files, "image", "left").select("image", F.coalesce(F.array_join("lines", "\n"), F.lit("")).alias("text"), F.coalesce(F.size("lines"), F.lit(0)).alias("n"))


def unlabelled_regions(images: DataFrame, boxes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows (image, x1, y1, x2, y2): the parts of images to paint over, as they show objects of classes that are dropped, have no target, or an unclear one."""
    m = mapping.select(F.col("class").alias("_class"), F.col("target").alias("_target"))
    rows = boxes.join(m, boxes["class"] == F.col("_class"), "left").join(images, "image").where(F.coalesce("_target", F.lit(DROP)).isin(DROP, CONFLICT))
    cut = clip(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("width").cast("double"), F.col("height").cast("double"))
    out = rows.select("image", *(v.alias(n) for v, n in zip(cut, ("x1", "y1", "x2", "y2"), strict=True)))
    return out.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def build_counts(images: DataFrame, boxes: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: images, boxes kept, dropped by class, too small, and images without a box."""
    m = mapping.select(F.col("class").alias("_class"), F.col("target").alias("_target"))
    # a mapping has a row for each class, of which there are few; joined by them, all boxes of a class would be one task's
    rows = boxes.join(F.broadcast(m), boxes["class"] == F.col("_class"), "left").join(images, "image")
    good = valid(clip(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("width").cast("double"), F.col("height").cast("double")))
    known = F.coalesce(F.col("_target"), F.lit(DROP)) != DROP
    per = rows.groupBy("image").agg(F.count_if(known & good).alias("kept"), F.count_if(~known).alias("dropped"), F.count_if(known & ~good).alias("bad"))
    every = images.select("image").join(per, "image", "left")
    return every.agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count_if(F.coalesce("kept", F.lit(0)) == 0).alias("empty"))

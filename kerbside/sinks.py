"""Writing tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.summaries import upsert_latest
from .sources import replay


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def replace_cameras(rows: DataFrame, path: str, cameras: list[str], by: str = "cctv_id") -> None:
    """The rows of these cameras become exactly those of `rows`; other cameras stay.

    Partitions are replaced one by one; that of a camera without new rows is
    deleted, which a dynamic overwrite would leave.  Calling it twice changes
    nothing.
    """
    spark = rows.sparkSession
    own = rows.where(F.col(by).isin(cameras)).cache()
    try:
        full = {r[0] for r in own.select(by).distinct().collect()}
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
        for camera in set(cameras) - full:
            p, fs = _path(spark, f"{path}/{by}={camera}")
            fs.delete(p, True)
    finally:
        own.unpersist()


def append(rows: DataFrame, path: str, keep: list[str]) -> None:
    """Appends chosen columns; those that `rows` lacks become null texts."""
    rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in keep)).write.mode("append").parquet(path)


def append_dated(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends rows to a table with a partition for each day of `ts`, so that a stretch of time reads its days alone."""
    rows.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def upsert(spark: SparkSession, rows: DataFrame, path: str, key: list[str], newest: str) -> None:
    """The table at `path` with `rows` merged in: of each key the newest row stays.

    A new table is written beside the old one, then takes its place.
    """
    old = spark.read.parquet(path) if exists(spark, path) else None
    merged = upsert_latest(old.unionByName(rows, allowMissingColumns=True) if old is not None else rows, key, [F.col(newest).desc()])
    merged.write.mode("overwrite").parquet(f"{path}.new")
    p, fs = _path(spark, path)
    fs.delete(p, True)
    fs.rename(_path(spark, f"{path}.new")[0], p)


def rename_key(rows: DataFrame, mapping: DataFrame, column: str = "cctv_id") -> DataFrame:
    """`rows` with old keys replaced by new ones (mapping: old, new; a short list); others stay."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return rows.join(m, rows[column] == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def rename_tables(spark: SparkSession, paths: list[str], mapping: dict[str, str], column: str = "cctv_id", dry: bool = False) -> dict[str, int]:
    """Rows changed at each path; with `dry` nothing is written.  Keys must be letters, digits and underscores."""
    bad = [k for k in [*mapping, *mapping.values()] if not k.replace("_", "").isalnum() or not k.isascii()]
    if bad:
        raise ValueError(f"not a key: {bad}")
    table = spark.createDataFrame(list(mapping.items()), "old string, new string")
    out = {}
    for path in paths:
        rows = spark.read.parquet(path)
        out[path] = rows.where(F.col(column).isin(list(mapping))).count()
        if out[path] and not dry:
            rename_key(rows, table, column).write.mode("overwrite").parquet(f"{path}.new")
            p, fs = _path(spark, path)
            fs.delete(p, True)
            fs.rename(_path(spark, f"{path}.new")[0], p)
    return out


def write_json(rows: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_labels(files: DataFrame, path: str) -> None:
    """Label texts (image, text, n) with one row for each image, those without a box included."""
    files.write.mode("overwrite").parquet(path)


def write_replays(objects: DataFrame, path: str, columns: list[str]) -> None:
    """Objects nested into gzipped documents, one for each camera."""
    replay.write(replay.nest(objects, "cctv_id", "frame", columns).withColumnRenamed("cctv_id", "location_code"), path)


def guard(spark: SparkSession, path: str, taxonomy: list[str]) -> None:
    """Raises if the data set at `path` has been built with another list of classes; else notes this one."""
    note = f"{path}/_classes"
    if exists(spark, note):
        old = [r.value for r in spark.read.text(note).orderBy("value").collect()]
        if old != sorted(f"{k:06d} {c}" for k, c in enumerate(taxonomy)):
            raise ValueError(f"{path} has other classes: {old}")
        return
    spark.createDataFrame([(f"{k:06d} {c}",) for k, c in enumerate(taxonomy)], "value string").coalesce(1).write.text(note)

"""Iterative plans over edge tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share.

    Where it is unset a local session gets a folder of its own; a cluster's
    machines share none, so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="kerbside-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df` without its lineage: a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) of edges (a, b): the smallest id reachable, by label passing with jumps."""
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    both = cut(both.union(both.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("component")).select(F.col("a").alias("id"), "component"))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        near = labels.join(seen, "id").select("id", F.col("component").alias("was"), F.least("component", "other").alias("component"))
        up = near.select(F.col("id").alias("component"), F.col("component").alias("up"))
        after = cut(near.join(up, "component", "left").select("id", "was", F.least("component", F.coalesce("up", "component")).alias("component")))
        labels = after.select("id", "component")
        if not after.where("was <> component").limit(1).count():
            return labels


def shortest(edges: DataFrame, limit: float) -> DataFrame:
    """Rows (src, dst, cost): least cost of every pair of different ends within `limit` over edges (src, dst, cost).

    Each round joins the ways found so far end to end, so that their number of
    edges doubles; the rounds end when no cost falls.  Costs below 0 are an error.
    """
    best = cut(edges.where((F.col("cost") <= limit) & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    if best.where("cost < 0").limit(1).count():
        raise ValueError("a cost below 0")
    while True:
        first, second = best.select("src", F.col("dst").alias("via"), F.col("cost").alias("a")), best.select(F.col("src").alias("via"), "dst", F.col("cost").alias("b"))
        longer = first.join(second, "via").where((F.col("a") + F.col("b") <= limit) & (F.col("src") != F.col("dst"))).select("src", "dst", (F.col("a") + F.col("b")).alias("cost"), F.lit(None).cast("double").alias("old"))
        merged = cut(longer.unionByName(best.withColumn("old", F.col("cost"))).groupBy("src", "dst").agg(F.min("cost").alias("cost"), F.min("old").alias("old")))
        best = merged.select("src", "dst", "cost")
        if not merged.where("old is null or cost < old").limit(1).count():
            return best

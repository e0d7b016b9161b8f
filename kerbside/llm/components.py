"""Connected components over an edge table, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component), component being the smallest id reachable, for every id in `edges` (a, b).

    Each round gives every node the smallest label among its neighbours and
    then the label of that label, so that the rounds grow with the logarithm
    of a chain's length.  Minimum aggregates combine before the shuffle, so a
    node with very many links costs no more than its share.  An empty edge
    table gives an empty result; null ends and loops are ignored.
    """
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    links = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(links.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = links.join(labels.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        pulled = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "other").alias("component"))
        # hooking: a label takes the smallest label that any of its nodes saw
        hooked = pulled.groupBy(F.col("was").alias("root")).agg(F.min("component").alias("root_to"))
        moved = pulled.join(hooked.withColumnRenamed("root", "was"), "was").select("id", "was", F.least("component", "root_to").alias("component"))
        jump = moved.select(F.col("id").alias("component"), F.col("component").alias("up"))
        after = materialize(moved.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        changed = after.where("was <> component").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels

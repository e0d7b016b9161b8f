"""Turning movements: transitions between links, smoothed shares, intervals, kinds of turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import difference, turn_label
from ..functions.stats import dirichlet, wilson
from .sequences import collapse, window

ALPHA, MIN_COUNT = 0.5, 5


def transitions(rows: DataFrame, by: list[str], order: list[str], link: str = "link_id", kind: str = "class") -> DataFrame:
    """Rows (from, to, class): each change of link of a track; a track's class is that of its first row; rows without a link are skipped."""
    seen = rows.where(F.col(link).isNotNull() & F.col(by[-1]).isNotNull())
    first = F.first(kind).over(window(by, order).rowsBetween(Window.unboundedPreceding, 0))
    runs = collapse(seen.withColumn("_class", first), by, order, link)
    return runs.select(F.col(link).alias("from"), F.lead(link).over(window(by, order)).alias("to"), F.col("_class").alias("class")).where("to is not null")


def turn_table(moves: DataFrame, ends: DataFrame | None = None, *, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """Rows (from, to, count, from_total, p_smoothed, ci_low, ci_high, by_class, sufficient, turn, delta_deg).

    `ends` has link_id, start_bearing, end_bearing; without it turns are
    `unknown`.  Counting by class first leaves few rows for each movement.
    """
    by_class = moves.groupBy("from", "to", "class").agg(F.count(F.lit(1)).alias("n"))
    table = by_class.groupBy("from", "to").agg(F.sum("n").alias("count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("class", F.lit("")).alias("class"), "n")))).alias("by_class"))
    leaving = Window.partitionBy("from")
    table = table.withColumn("from_total", F.sum("count").over(leaving)).withColumn("_k", F.count(F.lit(1)).over(leaving))
    low, high = wilson(F.col("count"), F.col("from_total"))
    table = table.select("from", "to", "count", "from_total", F.bround(dirichlet(F.col("count"), F.col("from_total"), F.col("_k"), alpha), 4).alias("p_smoothed"), F.bround(low, 4).alias("ci_low"), F.bround(high, 4).alias("ci_high"), "by_class", (F.col("from_total") >= min_count).alias("sufficient"))
    if ends is None:
        return table.withColumn("turn", F.lit("unknown")).withColumn("delta_deg", F.lit(None).cast("double"))
    out = table.join(ends.select(F.col("link_id").alias("from"), "end_bearing"), "from", "left").join(ends.select(F.col("link_id").alias("to"), "start_bearing"), "to", "left")
    return out.withColumn("turn", turn_label(F.col("end_bearing"), F.col("start_bearing"))).withColumn("delta_deg", F.bround(difference(F.col("start_bearing"), F.col("end_bearing")), 1)).drop("end_bearing", "start_bearing")


def turn_totals(table: DataFrame) -> DataFrame:
    """Movements by kind of turn."""
    return table.groupBy("turn").agg(F.sum("count").alias("count"))


def most_frequent(table: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent movements, by name on ties."""
    return table.orderBy(F.col("count").desc(), "from", "to").limit(n)


def link_ends(links: DataFrame) -> DataFrame:
    """Bearings (counter-clockwise from east) of the first and last segment of each link."""

    def toward(a, b):
        return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))

    p = F.col("pts")
    return links.where("size(pts) >= 2").select("link_id", toward(p[0], p[1]).alias("start_bearing"), toward(F.element_at(p, -2), F.element_at(p, -1)).alias("end_bearing"))

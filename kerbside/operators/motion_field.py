"""Speed along links: v(link, bin) from matched tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import interpolate, moving_average, window

# Bin length in metres, least tracks of a bin, half-width of the mean, bounds of a speed, speed of nothing known, fastest plausible speed.
BIN_M, MIN_N, SMOOTH, CLAMP, DEFAULT_KMH, FASTEST_KMH = 10.0, 3, 2, (15.0, 120.0), 50.0, 160.0


def pair_speeds(states: DataFrame, by: list[str], fps: float, bin_m: float = BIN_M) -> DataFrame:
    """Rows (by, link_id, bin, v): speeds of consecutive rows on one link, up to FASTEST_KMH; bin is that of the middle."""
    w = window(by, ["frame"])
    prev = states.withColumn("_l", F.lag("link_id").over(w)).withColumn("_s", F.lag("s").over(w)).withColumn("_f", F.lag("frame").over(w))
    dt = (F.col("frame") - F.col("_f")) / fps
    v = (F.col("s") - F.col("_s")) / F.nullif(dt, F.lit(0.0)) * 3.6
    own = prev.where(F.col("_l") == F.col("link_id")).where(dt > 1e-6).withColumn("v", v).where(F.col("v").between(0.0, FASTEST_KMH))
    return own.select(*by, "link_id", F.floor((F.col("s") + F.col("_s")) / 2.0 / bin_m).cast("int").alias("bin"), "v")


def track_medians(pairs: DataFrame, by: list[str]) -> DataFrame:
    """One speed for each track, link and bin: the median of three or more there, else the track's median on the link if it has two, else its own."""
    here = pairs.groupBy(*by, "link_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.lit(0.5)).alias("m"))
    there = pairs.groupBy(*by, "link_id").agg(F.count(F.lit(1)).alias("tn"), F.percentile("v", F.lit(0.5)).alias("tm"))
    v = F.when(F.col("n") >= 3, F.col("m")).when(F.col("tn") >= 2, F.col("tm")).otherwise(F.col("m"))
    return here.join(there, [*by, "link_id"]).select(*by, "link_id", "bin", v.alias("v"))


def build(per_track: DataFrame, links: DataFrame, *, bin_m: float = BIN_M, min_n: int = MIN_N, smooth: int = SMOOTH, clamp: tuple[float, float] = CLAMP) -> DataFrame:
    """Rows (link_id, bin, v_kmh, n, src, clamped) for every bin of every link (link_id, length).

    A bin seen by `min_n` tracks has their median; a link with two such bins
    fills the others along the line between them; other links take their own
    median, with `min_n` values, or that of all.  src says which: obs, interp,
    link, global.  Then a moving mean, where there are over two bins, and bounds.
    """
    observed = per_track.groupBy("link_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.lit(0.5)).alias("m"))
    link = per_track.groupBy("link_id").agg(F.count(F.lit(1)).alias("ln"), F.percentile("v", F.lit(0.5)).alias("lm"))
    # one row
    overall = per_track.agg(F.coalesce(F.percentile("v", F.lit(0.5)), F.lit(DEFAULT_KMH)).alias("gm"))
    bins = F.greatest(F.lit(1), F.ceil(F.col("length") / bin_m).cast("int"))
    grid = links.select("link_id", bins.alias("bins")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    rows = grid.join(observed, ["link_id", "bin"], "left").join(link, "link_id", "left").join(F.broadcast(overall), how="left", on=F.lit(True))
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("o", F.when(F.col("n") >= min_n, F.col("m")))
    rows = rows.withColumn("k", F.count("o").over(Window.partitionBy("link_id")))
    rows = interpolate(rows, ["link_id"], "bin", "o", "line")
    base = F.when(F.col("k") >= 2, F.col("line")).when(F.col("o").isNotNull(), F.col("o")).when(F.col("ln") >= min_n, F.col("lm")).otherwise(F.col("gm"))
    src = F.when(F.col("o").isNotNull(), "obs").when(F.col("k") >= 2, "interp").when(F.col("ln") >= min_n, "link").otherwise("global")
    rows = rows.select("link_id", "bin", "bins", "n", src.alias("src"), base.alias("b"))
    rows = rows.withColumn("v", F.when(F.col("bins") > 2, moving_average("b", ["link_id"], ["bin"], smooth)).otherwise(F.col("b")))
    bounded = F.greatest(F.lit(clamp[0]), F.least(F.lit(clamp[1]), F.col("v")))
    return rows.select("link_id", "bin", F.round(bounded, 2).alias("v_kmh"), "n", "src", (bounded != F.col("v")).alias("clamped"))


def lookup(points: DataFrame, field: DataFrame, bin_m: float = BIN_M) -> DataFrame:
    """`points` (link_id, s) with v_kmh, linear between bin centres and level beyond the outer ones, and the source of the bin.

    A link's bins are one row of arrays, so that points meet them once.
    """
    bins = field.groupBy("link_id").agg(F.max("bin").alias("_last"), F.map_from_entries(F.collect_list(F.struct(F.col("bin"), F.struct("v_kmh", "src")))).alias("_m"))
    dense = bins.select("link_id", "_last", F.transform(F.sequence(F.lit(0), F.col("_last").cast("int")), lambda b: F.col("_m")[b]).alias("_f"))
    rows = points.join(dense, "link_id", "left")
    x = F.greatest(F.lit(0.0), F.least(F.col("_last").cast("double"), F.col("s") / bin_m - 0.5))
    own = F.greatest(F.lit(0), F.least(F.col("_last"), F.floor(F.col("s") / bin_m).cast("int")))
    rows = rows.withColumn("_x", x).withColumn("_i", F.floor("_x").cast("int"))
    a, b = F.get("_f", F.col("_i"))["v_kmh"], F.get("_f", F.least(F.col("_i") + 1, F.col("_last")))["v_kmh"]
    return rows.withColumns({"v_kmh": a + (F.col("_x") - F.col("_i")) * (b - a), "src": F.get("_f", own)["src"]}).drop("_last", "_x", "_i", "_f")


def provenance(field: DataFrame) -> DataFrame:
    """Bins by source."""
    return field.groupBy("src").agg(F.count(F.lit(1)).alias("n"))


def coverage(field: DataFrame) -> DataFrame:
    """One row: bins, observed bins and their share, clamped bins."""
    obs = F.count_if(F.col("src") == "obs")
    return field.agg(F.count(F.lit(1)).alias("bins"), obs.alias("observed"), F.round(100.0 * obs / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("observed_pct"), F.count_if("clamped").alias("clamped"))


def lateral_medians(states: DataFrame) -> DataFrame:
    """Median distance from the lane by link."""
    return states.groupBy("link_id").agg(F.percentile(F.abs("d"), F.lit(0.5)).alias("lat_med"))


def gradients(field: DataFrame, bin_m: float = BIN_M) -> DataFrame:
    """One row: median and 95th percentile of the change between bins, and of the acceleration it implies."""
    dv = F.col("v_kmh") - F.lag("v_kmh").over(window(["link_id"], ["bin"]))
    mean = (F.col("v_kmh") + F.lag("v_kmh").over(window(["link_id"], ["bin"]))) / 2.0
    rows = field.select(F.abs(dv).alias("dv"), F.abs(dv / 3.6 * (mean / 3.6) / bin_m).alias("a")).where("dv is not null")
    return rows.agg(F.percentile("dv", F.lit(0.5)).alias("dv_median"), F.percentile("dv", F.lit(0.95)).alias("dv_p95"), F.percentile("a", F.lit(0.95)).alias("accel_p95"))


def to_arrays(field: DataFrame) -> DataFrame:
    """One row for each link, as an export has them: v_kmh, n and src as arrays by bin."""
    rows = field.groupBy("link_id").agg(F.array_sort(F.collect_list(F.struct("bin", "v_kmh", "n", "src"))).alias("b"))
    return rows.select("link_id", F.col("b.v_kmh").alias("v_kmh"), F.col("b.n").alias("n"), F.col("b.src").alias("src"))

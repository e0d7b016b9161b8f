"""Queries of the relational core: summaries, transitions, sequences, joins, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.angles import turn_label
from ..functions.stats import dirichlet, wilson
from ..operators import align, masks, motion_field, sequences, spatial_join, summaries, taxonomy, turns
from ..service import map_command
from ..sinks import rename_key
from ..sources import cameras as directories
from ..sources import datasets, replay
from . import tables
from .tables import BOXES, CAMERAS, DETECTIONS, TRACKS, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH d AS ({DETECTIONS}), c AS ({CAMERAS})
SELECT d.cctv_id, coalesce(c.name, d.cctv_id) AS name, count(DISTINCT track_id)::BIGINT AS n_objects, count(*)::BIGINT AS n_detections,
 round(avg(CASE WHEN speed_kmh > 1 THEN speed_kmh END), 1) AS avg_speed_kmh FROM d LEFT JOIN c USING (cctv_id) GROUP BY 1, 2""")
def camera_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.camera_summary(tables.detections(spark, sf_dir), tables.cameras(spark, sf_dir))


@query(f"""WITH d AS ({DETECTIONS}) SELECT cctv_id, round(avg(speed_kmh) FILTER (WHERE speed_kmh > 1), 1) AS avg_speed_kmh, count(*)::BIGINT AS n,
 count(DISTINCT track_id)::BIGINT AS n_objects FROM d GROUP BY 1""")
def camera_summary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.detections(spark, sf_dir).createOrReplaceTempView("kerbside_detection")
    return spark.sql("SELECT cctv_id, round(avg(speed_kmh) FILTER (WHERE speed_kmh > 1), 1) AS avg_speed_kmh, count(*) AS n, count(DISTINCT track_id) AS n_objects FROM kerbside_detection GROUP BY cctv_id")


@query(f"""WITH d AS ({DETECTIONS}) SELECT cctv_id, count(DISTINCT track_id)::BIGINT AS n_objects FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def busiest_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.busiest(tables.detections(spark, sf_dir))


@query(f"""WITH d AS ({DETECTIONS}) SELECT class, count(DISTINCT track_id)::BIGINT AS n_objects FROM d GROUP BY 1""")
def distinct_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.objects_by_class(tables.detections(spark, sf_dir))


@query("""SELECT event_type AS cctv_id, user_id AS frame, event_id AS id, value AS speed_kmh FROM events WHERE value > 1""")
def replay_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("cctv_id"), F.col("user_id").alias("frame"), F.col("event_id").alias("id"), F.col("value").alias("speed_kmh"))
    nested = replay.nest(e, "cctv_id", "frame", ["id", "speed_kmh"])
    each = nested.select("cctv_id", F.explode("frames").alias("f")).select("cctv_id", F.col("f.frame_index").alias("frame"), F.explode("f.objects").alias("o"))
    return each.select("cctv_id", "frame", "o.id", "o.speed_kmh").where("speed_kmh > 1")


@query("""SELECT event_id AS frame, 1767225600000000 + round(event_id / 30.0::DOUBLE * 1000000)::BIGINT AS micros FROM events""")
def detection_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("frame"))
    return e.select("frame", F.unix_micros(replay.time_of(F.col("frame"), F.lit(30.0), "2026-01-01 00:00:00+00:00")).alias("micros"))


_MOVES = f"""d AS ({TRACKS}), p AS (SELECT *, lag(link_id) OVER w AS prev, first_value(class) OVER w AS kind FROM d WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
 r AS (SELECT * FROM p WHERE prev IS NULL OR prev <> link_id), m AS (SELECT link_id AS a, lead(link_id) OVER (PARTITION BY track_id ORDER BY frame) AS b, kind FROM r)"""
_TABLE = f"""{_MOVES}, t AS (SELECT a, b, count(*)::BIGINT AS n FROM m WHERE b IS NOT NULL GROUP BY 1, 2),
 s AS (SELECT *, sum(n) OVER (PARTITION BY a)::BIGINT AS tot, count(*) OVER (PARTITION BY a)::BIGINT AS k FROM t)"""


@query(f"""WITH {_TABLE} SELECT a AS "from", b AS "to", n AS "count", tot AS from_total, round((n + 0.5) / (tot + 0.5 * k), 6) AS p,
 round(greatest(0.0, (n / tot + 1.9208 / tot - 1.96 * sqrt((n / tot) * (1 - n / tot) / tot + 0.9604 / (tot * tot))) / (1 + 3.8416 / tot)), 6) AS ci_low,
 round(least(1.0, (n / tot + 1.9208 / tot + 1.96 * sqrt((n / tot) * (1 - n / tot) / tot + 0.9604 / (tot * tot))) / (1 + 3.8416 / tot)), 6) AS ci_high,
 tot >= 5 AS sufficient FROM s""")
def link_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = turns.transitions(tables.tracks(spark, sf_dir), ["track_id"], ["frame"])
    t = turns.turn_table(moves).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("from")))
    low, high = wilson(F.col("count"), F.col("from_total"))
    return t.select("from", "to", "count", "from_total", F.round(dirichlet(F.col("count"), F.col("from_total"), F.col("k")), 6).alias("p"), F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"), "sufficient")


@query(f"""WITH {_MOVES} SELECT a AS "from", b AS "to", kind AS class, count(*)::BIGINT AS n FROM m WHERE b IS NOT NULL GROUP BY 1, 2, 3""")
def transitions_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = turns.transitions(tables.tracks(spark, sf_dir), ["track_id"], ["frame"])
    t = turns.turn_table(moves)
    return t.select("from", "to", F.explode("by_class").alias("class", "n"))


_BEARING = "(length({0}) * 53 + ascii({0}) * 7) % 360 - 180.0::DOUBLE"
_WRAP = "({0}) - 360.0 * floor((({0}) + 180.0) / 360.0)"
_LABEL = "CASE WHEN {0} < -135 THEN 'uturn' WHEN {0} < -35 THEN 'right' WHEN {0} < 35 THEN 'straight' WHEN {0} < 135 THEN 'left' ELSE 'uturn' END"


@query(f"""WITH {_TABLE}, u AS (SELECT n, {_WRAP.format(_BEARING.format("b") + " - (" + _BEARING.format("a") + ")")} AS delta FROM s)
 SELECT {_LABEL.format("delta")} AS turn, sum(n)::BIGINT AS "count" FROM u GROUP BY 1""")
def turn_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.tracks(spark, sf_dir)
    bearing = (F.length("link_id") * 53 + F.ascii("link_id") * 7) % 360 - F.lit(180.0)
    ends = rows.select("link_id").distinct().select("link_id", bearing.alias("start_bearing"), bearing.alias("end_bearing"))
    return turns.turn_totals(turns.turn_table(turns.transitions(rows, ["track_id"], ["frame"]), ends))


@query(f"""WITH {_TABLE} SELECT a AS "from", b AS "to", n AS "count" FROM s ORDER BY n DESC, a, b LIMIT 20""")
def most_frequent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns.turn_table(turns.transitions(tables.tracks(spark, sf_dir), ["track_id"], ["frame"]))
    return turns.most_frequent(t).select("from", "to", "count")


@query(f"""WITH {_TABLE} SELECT count(*) FILTER (WHERE tot >= 400)::BIGINT AS sufficient, count(*)::BIGINT AS "all" FROM s""")
def turn_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns.turn_table(turns.transitions(tables.tracks(spark, sf_dir), ["track_id"], ["frame"]), min_count=400)
    return t.agg(F.count_if("sufficient").alias("sufficient"), F.count(F.lit(1)).alias("all"))


_STEP = f"d AS ({TRACKS}), v AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) / ((frame - lag(frame) OVER w) / 10.0::DOUBLE) * 3.6 AS v FROM d WINDOW w AS (PARTITION BY track_id ORDER BY frame))"


@query(f"""WITH {_STEP}, l AS (SELECT track_id, max(frame) - min(frame) AS span, count(DISTINCT frame) AS seen FROM d GROUP BY 1),
 t AS (SELECT count(*)::BIGINT AS n_tracks, round(quantile_cont(span / 10.0::DOUBLE, 0.5), 6) AS median_life, round(quantile_cont(span / 10.0::DOUBLE, 0.9), 6) AS p90_life,
 round(100.0 * avg((span / 10.0::DOUBLE < 900.0)::INT), 6) AS short_pct, round(100.0 * sum(seen) / sum(span + 1), 6) AS cover_pct FROM l),
 s AS (SELECT count(*) FILTER (WHERE v > 180)::BIGINT AS n_impossible, round(quantile_cont(v, 0.99), 6) AS p99_speed FROM v WHERE v IS NOT NULL) SELECT 'cam' AS cctv_id, * FROM t, s""")
def track_fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = summaries.fragmentation(tables.tracks(spark, sf_dir), 10.0, short_s=900.0)
    return f.select("cctv_id", "n_tracks", *(F.round(c, 6).alias(c) for c in ("median_life", "p90_life", "short_pct", "cover_pct")), "n_impossible", F.round("p99_speed", 6).alias("p99_speed"))


@query(f"""WITH {_STEP} SELECT track_id, frame, round(v, 6) AS v FROM v""")
def instant_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sequences.window(["track_id"], ["frame"])
    return tables.tracks(spark, sf_dir).select("track_id", "frame", F.round(sequences.speed_kmh(F.col("x"), F.col("y"), F.col("frame") / 10.0, w), 6).alias("v"))


@query(f"""WITH {_STEP}, i AS (SELECT *, sum(CASE WHEN v > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame) AS piece FROM v),
 n AS (SELECT *, count(*) OVER (PARTITION BY track_id, piece) AS k, max(piece) OVER (PARTITION BY track_id) AS m FROM i)
 SELECT CASE WHEN m > 0 THEN track_id || '#' || piece::BIGINT ELSE track_id::VARCHAR END AS segment_id, count(*)::BIGINT AS n FROM n WHERE k >= 2 GROUP BY 1""")
def sessions_by_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.tracks(spark, sf_dir).withColumn("t", F.col("frame") / 10.0)
    return sequences.split_on_jumps(rows, ["track_id"], ["frame"], 60.0).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS ({TRACKS}), p AS (SELECT *, lag(link_id) OVER (PARTITION BY track_id ORDER BY frame) AS prev FROM d) SELECT track_id, count(*)::BIGINT AS runs FROM p WHERE prev IS NULL OR prev <> link_id GROUP BY 1""")
def run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.collapse(tables.tracks(spark, sf_dir), ["track_id"], ["frame"], "link_id").groupBy("track_id").agg(F.count(F.lit(1)).alias("runs"))


@query(f"""WITH d AS ({TRACKS}), p AS (SELECT *, CASE WHEN lag(link_id) OVER w <> link_id THEN 1 ELSE 0 END AS brk FROM d WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
 i AS (SELECT *, sum(brk) OVER (PARTITION BY track_id ORDER BY frame) AS run FROM p), c AS (SELECT track_id, run, count(*) AS n, min(frame) AS f FROM i GROUP BY 1, 2),
 b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, run) AS r FROM c) SELECT track_id, f AS first_frame, n::BIGINT AS n FROM b WHERE r = 1""")
def longest_link_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.tracks(spark, sf_dir)
    breaks = F.coalesce(F.lag("link_id").over(sequences.window(["track_id"], ["frame"])) != F.col("link_id"), F.lit(False))
    return sequences.longest_run(rows, ["track_id"], ["frame"], breaks).groupBy("track_id").agg(F.min("frame").alias("first_frame"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS ({TRACKS}) SELECT track_id, frame, round(quantile_cont(x, 0.5) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS m FROM d""")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tracks(spark, sf_dir).select("track_id", "frame", F.round(sequences.median_filter("x", sequences.window(["track_id"], ["frame"])), 6).alias("m"))


@query(f"""WITH d AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY track_id) AS n FROM ({TRACKS}) WINDOW w AS (PARTITION BY track_id ORDER BY frame))
 SELECT a.track_id, a.frame, round(sum(b.x) / 5.0, 6) AS m FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS k FROM d) a JOIN d b ON a.track_id = b.track_id AND b.i = least(a.n, greatest(1, a.i + a.k)) GROUP BY 1, 2""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tracks(spark, sf_dir).select("track_id", "frame", F.round(sequences.moving_average("x", ["track_id"], ["frame"], 2), 6).alias("m"))


@query(f"""WITH d AS ({TRACKS}), s AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0.0) AS st FROM d WINDOW w AS (PARTITION BY track_id ORDER BY frame))
 SELECT track_id, frame, round(sum(st) OVER (PARTITION BY track_id ORDER BY frame), 4) AS s FROM s""")
def arc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.with_arc_length(tables.tracks(spark, sf_dir), ["track_id"], ["frame"]).select("track_id", "frame", F.round("s", 4).alias("s"))


@query(f"""WITH d AS ({TRACKS}) SELECT track_id, frame, round(sqrt(power(max(x) OVER w - min(x) OVER w, 2) + power(max(y) OVER w - min(y) OVER w, 2)), 6) AS r FROM d
 WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def jitter_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tracks(spark, sf_dir).select("track_id", "frame", F.round(sequences.jitter_radius("x", "y", sequences.window(["track_id"], ["frame"])), 6).alias("r"))


@query(f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS i FROM ({TRACKS})),
 e AS (SELECT track_id, frame, i, x AS v FROM d WHERE i = 1 UNION ALL SELECT d.track_id, d.frame, d.i, 0.4 * d.x + 0.6 * e.v FROM e JOIN d ON d.track_id = e.track_id AND d.i = e.i + 1)
 SELECT track_id, frame, round(v, 6) AS ema FROM e""")
def speed_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.ema(tables.tracks(spark, sf_dir), ["track_id"], "frame", "x", 0.4).withColumn("ema", F.round("ema", 6))


@query(f"""WITH d AS ({TRACKS}), k AS (SELECT track_id, frame, CASE WHEN frame % 3 = 0 THEN x END AS v FROM d),
 f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS fa, last_value(v IGNORE NULLS) OVER a AS va, first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS fb, first_value(v IGNORE NULLS) OVER b AS vb
 FROM k WINDOW a AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT track_id, frame, round(CASE WHEN v IS NOT NULL THEN v WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va ELSE va + (frame - fa)::DOUBLE / (fb - fa) * (vb - va) END, 9) AS v FROM f""")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.tracks(spark, sf_dir).select("track_id", "frame", F.when(F.col("frame") % 3 == 0, F.col("x")).alias("known"))
    return sequences.interpolate(rows, ["track_id"], "frame", "known", "v").select("track_id", "frame", F.round("v", 9).alias("v"))


@query(f"""WITH d AS ({TRACKS}), n AS (SELECT track_id, frame AS t1, x AS x1, lead(frame) OVER w AS t2, lead(x) OVER w AS x2, lag(frame) OVER w AS t0, lag(x) OVER w AS x0, lead(frame, 2) OVER w AS t3, lead(x, 2) OVER w AS x3 FROM d WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
 k AS (SELECT *, unnest(generate_series(ceil(t1 / 50.0)::BIGINT, ceil(t2 / 50.0)::BIGINT - 1)) AS tick FROM n WHERE t2 > t1), u AS (SELECT *, (tick * 50.0 - t1) / (t2 - t1) AS u, greatest(t1 - t0, t2 - t1, t3 - t2) AS hi, least(t1 - t0, t2 - t1, t3 - t2) AS lo FROM k)
 SELECT track_id, tick, round(CASE WHEN t0 IS NOT NULL AND t3 IS NOT NULL AND hi < 1.2 * lo THEN 0.5 * (2 * x1 + (x2 - x0) * u + (2 * x0 - 5 * x1 + 4 * x2 - x3) * u * u + (3 * x1 - x0 - 3 * x2 + x3) * u * u * u) ELSE x1 + (x2 - x1) * u END, 9) AS x FROM u""")
def resample_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.tracks(spark, sf_dir).select("track_id", F.col("frame").cast("double").alias("t"), "x")
    return sequences.resample(rows, ["track_id"], 50.0, values=("x",)).select("track_id", "tick", F.round("x", 9).alias("x"))


@query("""WITH e AS (SELECT s_suppkey, s_acctbal, n_nationkey, abs(s_acctbal - n_nationkey * 400.0) AS dist, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - n_nationkey * 400.0), n_nationkey) AS r FROM supplier, nation)
 SELECT s_suppkey, n_nationkey AS r_n_nationkey, round(dist, 6) AS distance FROM e WHERE r = 1""")
def nearest_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"))
    n = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 400.0).alias("x"), F.lit(0.0).alias("y"))
    return spatial_join.nearest(s, n, "s_suppkey", "n_nationkey").withColumn("distance", F.round("distance", 6))


@query("""WITH e AS (SELECT s_suppkey, n_nationkey, abs(s_acctbal - n_nationkey * 400.0) AS dist, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - n_nationkey * 400.0), n_nationkey) AS r FROM supplier, nation WHERE abs(s_acctbal - n_nationkey * 400.0) <= 120)
 SELECT s.s_suppkey, n_nationkey AS r_n_nationkey, round(dist, 6) AS distance FROM supplier s LEFT JOIN e ON e.s_suppkey = s.s_suppkey AND r = 1""")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"))
    n = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 400.0).alias("x"), F.lit(0.0).alias("y"))
    return spatial_join.nearest(s, n, "s_suppkey", "n_nationkey", distance=120.0).withColumn("distance", F.round("distance", 6))


@query("""WITH e AS (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS r FROM customer, supplier WHERE abs(c_acctbal - s_acctbal) <= 300)
 SELECT c_custkey, s_suppkey AS r_s_suppkey, round(d, 6) AS distance, r::INT AS rank FROM e WHERE r <= 3""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"))
    return spatial_join.nearest_k(c, s, "c_custkey", "s_suppkey", 3, 300.0).select("c_custkey", "r_s_suppkey", F.round("distance", 6).alias("distance"), "rank")


@query("""SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE abs(c.c_acctbal - s.s_acctbal) < 40)""")
def anti_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"))
    return spatial_join.without_neighbours(c, s, "c_custkey", 40.0).select("c_custkey")


@query("""SELECT a.s_suppkey, b.s_suppkey AS r_s_suppkey FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE sqrt(power(a.s_acctbal - b.s_acctbal, 2) + power((a.s_nationkey - b.s_nationkey) * 10.0, 2)) <= 60""")
def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 10.0).alias("y"))
    return spatial_join.neighbours(s, "s_suppkey", 60.0).select("s_suppkey", "r_s_suppkey")


@query("""SELECT c_custkey AS cctv_id, c_acctbal AS lon FROM (SELECT *, sqrt(power((c_acctbal / 100.0 - 40.0) * 88800.0, 2) + power((c_nationkey - 10.0) * 111000.0, 2)) AS d FROM customer) ORDER BY d, c_custkey LIMIT 5 OFFSET 2""")
def nearest_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cctv_id"), (F.col("c_acctbal") / 100.0).alias("lon"), F.col("c_nationkey").cast("double").alias("lat"), F.col("c_acctbal").alias("v"))
    return directories.nearest_to(c, 40.0, 10.0, 5, 2).select("cctv_id", F.col("v").alias("lon"))


@query(f"""WITH d AS ({TRACKS}) SELECT track_id, round(degrees(atan2(sum(sin(radians(x * 7))), sum(cos(radians(x * 7))))), 5) AS mean FROM d GROUP BY 1""")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.angles import circular_mean as mean

    return tables.tracks(spark, sf_dir).groupBy("track_id").agg(F.round(mean(F.col("x") * 7), 5).alias("mean"))


@query(f"""WITH d AS ({TRACKS}) SELECT track_id, avg(cos(radians(x * 7))) < -0.02 AND count(*) FILTER (WHERE frame % 2 = 0) * 2 > count(*) AS wrong_way FROM d GROUP BY 1""")
def wrong_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.tracks(spark, sf_dir)
    return d.groupBy("track_id").agg(((F.avg(F.cos(F.radians(F.col("x") * 7))) < -0.02) & (F.count_if(F.col("frame") % 2 == 0) * 2 > F.count(F.lit(1)))).alias("wrong_way"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.upsert_latest(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT coalesce(m.new, e.event_type) AS cctv_id, count(*)::BIGINT AS n FROM events e LEFT JOIN (VALUES ('click', 'tap'), ('view', 'look')) m(old, new) ON m.old = e.event_type GROUP BY 1""")
def rename_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.createDataFrame([("click", "tap"), ("view", "look")], "old string, new string")
    return rename_key(read(spark, sf_dir, "events").select(F.col("event_type").alias("cctv_id")), m).groupBy("cctv_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'car' ELSE 'van' END AS target, count(*)::BIGINT AS n FROM events WHERE event_type <> 'error' GROUP BY 1""")
def taxonomy_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("class"))
    kinds = sorted(r[0] for r in e.distinct().collect())  # a handful of classes
    m = spark.createDataFrame([(k, "car" if k in ("click", "view") else taxonomy.DROP if k == "error" else "van") for k in kinds], "class string, target string")
    return taxonomy.remap(e, m).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, format('{:d} {:.6f} {:.6f} {:.6f} {:.6f}', p_size % 7, 0.5, (p_partkey % 100) / 200.0, p_size / 100.0, (p_partkey % 100) / 100.0) AS line FROM part WHERE p_size >= 3 AND p_partkey % 100 >= 3""")
def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("h", (F.col("p_partkey") % 100).cast("double")).withColumn("w", F.col("p_size").cast("double"))
    box = (50.0 - F.col("w") / 2.0, F.lit(0.0), 50.0 + F.col("w") / 2.0, F.col("h"))
    return p.where(taxonomy.valid(box)).select("p_partkey", taxonomy.label_line(F.col("p_size") % 7, box, F.lit(100.0), F.lit(100.0)).alias("line"))


@query(f"""WITH b AS ({BOXES}), c AS (SELECT *, (greatest(0, least(x2, 300) - greatest(x1, 100)) * greatest(0, least(y2, 400) - greatest(y1, 0)) + greatest(0, least(x2, 800) - greatest(x1, 500)) * greatest(0, least(y2, 600) - greatest(y1, 200))) / ((x2 - x1) * (y2 - y1)) AS share FROM b)
 SELECT cctv_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE share >= 0.6)::BIGINT AS dropped FROM c GROUP BY 1""")
def mask_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    cut = masks.pixels(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), 100_000, 100_000)
    share = masks.covered_by(cut, [(100, 0, 300, 400), (500, 200, 800, 600)])
    return b.groupBy("cctv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(share >= masks.COVER).alias("dropped"))


@query(f"""WITH b AS ({BOXES}) SELECT l_orderkey, l_linenumber FROM b WHERE (x1 + x2) / 2 BETWEEN 200 AND 400 AND (y1 + y2) / 2 BETWEEN 100 AND 300""")
def roi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    return b.where(datasets.centre_in(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), (200.0, 100.0, 400.0, 300.0))).select("l_orderkey", "l_linenumber")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 900 AND c_nationkey BETWEEN 3 AND 9""")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directories.read_table(read(spark, sf_dir, "customer"), (100.0, 3.0, 900.0, 9.0), "c_acctbal", "c_nationkey").select("c_custkey")


@query("""SELECT s_suppkey, 'https://example.org/live?key=k&cctvid=' || s_suppkey || '&cctvName=' || replace(s_name, '#', '%23') || '&kind=E' AS url FROM supplier""")
def stream_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", directories.stream_url("https://example.org/live", "k", F.col("s_suppkey"), F.col("s_name"), F.lit("E")).alias("url"))


@query("""WITH k AS (SELECT DISTINCT o_custkey FROM orders), n AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS i FROM k) SELECT o.o_orderkey FROM orders o JOIN n USING (o_custkey) WHERE i % 4 = 0""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.every(read(spark, sf_dir, "orders"), "o_custkey", 4).select("o_orderkey")


@query("""WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey FROM n WHERE i IN (SELECT floor(k * (n - 1)::DOUBLE / 99)::BIGINT FROM (SELECT unnest(range(100)) AS k, (SELECT max(n) FROM n) AS n))""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.even(read(spark, sf_dir, "part"), 100, "p_partkey").select("p_partkey")


@query("""SELECT DISTINCT event_type AS class FROM events WHERE event_type NOT IN ('click', 'view')""")
def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.unknown(read(spark, sf_dir, "events").select(F.col("event_type").alias("class")), spark.createDataFrame([("click",), ("view",)], "class string"))


@query("""SELECT n_name AS name, 0 AS src FROM nation UNION ALL SELECT r_name AS name, 1 AS src FROM region""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit(0).alias("src"))
    b = read(spark, sf_dir, "region").select(F.lit(1).alias("src"), F.col("r_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def section_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return directories.unique_by(li, ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("""SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 45)""")
def semi_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("frame"))
    return datasets.predictions(read(spark, sf_dir, "orders").withColumn("frame", F.col("o_orderkey")), frames).select("o_orderkey")


@query("""WITH q AS (SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 3 = 0 THEN 'please show nation _' || (o_orderkey % 25) ELSE 'count of NATION_1' END AS text FROM orders),
 h AS (SELECT question_id, n_nationkey::VARCHAR AS cctv_id, n_name FROM q JOIN nation ON contains(replace(lower(text), ' ', ''), lower(n_name)) WHERE regexp_matches(lower(text), '\\b(show|find)\\b'))
 SELECT question_id, arg_min(cctv_id, n_name) AS cctv_id FROM h GROUP BY 1""")
def map_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    q = o.select(F.col("o_orderkey").alias("question_id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("please show nation _"), (F.col("o_orderkey") % 25).cast("string"))).otherwise(F.lit("count of NATION_1")).alias("text"))
    c = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("cctv_id"), F.col("n_name").alias("name"))
    return map_command(q, c)


_SHIFT = "SELECT count(l_discount)::BIGINT AS n, round(avg(l_tax), 6) AS mean, round(quantile_cont(l_tax, 0.5), 6) AS median, round(quantile_cont(l_tax, 0.95), 6) AS p95, max(l_tax) AS max, l_returnflag FROM lineitem GROUP BY l_returnflag"


@query(_SHIFT)
def shift_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summaries.shift_stats(read(spark, sf_dir, "lineitem"), "l_tax", ["l_returnflag"])
    return s.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95")), "max", "l_returnflag")


_STATES = "SELECT 'L' || (min(l_partkey) % 40) AS link_id, l_suppkey AS track_id, l_orderkey AS frame, max(l_quantity) * 2.0 AS s FROM lineitem GROUP BY l_suppkey, l_orderkey"
_PAIRS = f"""p AS (SELECT *, lag(link_id) OVER w AS pl, lag(s) OVER w AS ps, lag(frame) OVER w AS pf FROM ({_STATES}) WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
 v AS (SELECT track_id, link_id, floor((s + ps) / 2.0 / 10.0)::INT AS bin, (s - ps) / ((frame - pf) / 30.0::DOUBLE) * 3.6 AS v FROM p WHERE pl = link_id AND (frame - pf) / 30.0 > 1e-6), k AS (SELECT * FROM v WHERE v BETWEEN 0 AND 160),
 h AS (SELECT track_id, link_id, bin, count(*) AS n, quantile_cont(v, 0.5) AS m FROM k GROUP BY 1, 2, 3), t AS (SELECT track_id, link_id, count(*) AS tn, quantile_cont(v, 0.5) AS tm FROM k GROUP BY 1, 2),
 q AS (SELECT track_id, link_id, bin, CASE WHEN n >= 3 THEN m WHEN tn >= 2 THEN tm ELSE m END AS v FROM h JOIN t USING (track_id, link_id))"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("track_id"), F.col("l_orderkey").alias("frame")).agg(F.min("l_partkey").alias("p"), F.max("l_quantity").alias("q"))
    return li.select(F.concat(F.lit("L"), (F.col("p") % 40).cast("string")).alias("link_id"), "track_id", "frame", (F.col("q") * 2.0).alias("s"))


def _per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion_field.track_medians(motion_field.pair_speeds(_states(spark, sf_dir), ["track_id"], 30.0), ["track_id"])


@query(f"WITH {_PAIRS} SELECT track_id, link_id, bin, round(v, 6) AS v FROM q")
def track_bin_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_track(spark, sf_dir).select("track_id", "link_id", "bin", F.round("v", 6).alias("v"))


_FIELD = f"""{_PAIRS}, o AS (SELECT link_id, bin, count(*) AS n, quantile_cont(v, 0.5) AS m FROM q GROUP BY 1, 2), l AS (SELECT link_id, count(*) AS ln, quantile_cont(v, 0.5) AS lm FROM q GROUP BY 1),
 a AS (SELECT coalesce(quantile_cont(v, 0.5), 50.0) AS gm FROM q), g AS (SELECT 'L' || i AS link_id, unnest(range(10 + i % 3))::INT AS bin, (10 + i % 3)::INT AS bins FROM (SELECT unnest(range(40)) AS i)),
 r AS (SELECT g.*, coalesce(o.n, 0)::BIGINT AS n, CASE WHEN o.n >= 3 THEN o.m END AS o, l.ln, l.lm, a.gm FROM g LEFT JOIN o USING (link_id, bin) LEFT JOIN l USING (link_id), a),
 x AS (SELECT *, count(o) OVER (PARTITION BY link_id) AS k, last_value(CASE WHEN o IS NOT NULL THEN bin END IGNORE NULLS) OVER p AS ba, last_value(o IGNORE NULLS) OVER p AS oa, first_value(CASE WHEN o IS NOT NULL THEN bin END IGNORE NULLS) OVER s AS bb, first_value(o IGNORE NULLS) OVER s AS ob FROM r
 WINDOW p AS (PARTITION BY link_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), s AS (PARTITION BY link_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 y AS (SELECT *, CASE WHEN o IS NOT NULL THEN o WHEN k >= 2 THEN CASE WHEN oa IS NULL THEN ob WHEN ob IS NULL THEN oa ELSE oa + (bin - ba)::DOUBLE / (bb - ba) * (ob - oa) END WHEN ln >= 3 THEN lm ELSE gm END AS b,
 CASE WHEN o IS NOT NULL THEN 'obs' WHEN k >= 2 THEN 'interp' WHEN ln >= 3 THEN 'link' ELSE 'global' END AS src FROM x),
 z AS (SELECT c.link_id, c.bin, c.n, c.src, sum(d.b) / 5.0 AS v FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS j FROM y) c JOIN y d ON d.link_id = c.link_id AND d.bin = least(c.bins - 1, greatest(0, c.bin + c.j)) GROUP BY 1, 2, 3, 4)"""


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spark.range(40).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("link_id"), (100.0 + F.col("id") % 3 * 10.0).alias("length"))
    return motion_field.build(_per_track(spark, sf_dir), links)


@query(f"WITH {_FIELD} SELECT link_id, bin, round(greatest(15.0, least(120.0, v)), 2) AS v_kmh, n, src FROM z")
def motion_field_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, sf_dir).select("link_id", "bin", "v_kmh", "n", "src")


@query(f"WITH {_FIELD} SELECT src, count(*)::BIGINT AS n FROM z GROUP BY 1")
def field_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion_field.provenance(_field(spark, sf_dir))


@query(f"""WITH {_FIELD}, w AS (SELECT link_id, bin, round(greatest(15.0, least(120.0, v)), 2) AS v FROM z), mm AS (SELECT link_id, max(bin) AS last FROM w GROUP BY 1),
 pp AS (SELECT s.*, greatest(0.0, least(last::DOUBLE, s / 10.0 - 0.5)) AS x, last FROM ({_STATES}) s JOIN mm USING (link_id))
 SELECT pp.link_id, track_id, frame, round(a.v + (x - floor(x)) * (b.v - a.v), 4) AS v_kmh FROM pp JOIN w a ON a.link_id = pp.link_id AND a.bin = floor(x) JOIN w b ON b.link_id = pp.link_id AND b.bin = least(floor(x) + 1, last)""")
def field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion_field.lookup(_states(spark, sf_dir), _field(spark, sf_dir)).select("link_id", "track_id", "frame", F.round("v_kmh", 4).alias("v_kmh"))


@query(f"""WITH {_FIELD} SELECT count(*)::BIGINT AS bins, count(*) FILTER (WHERE src = 'obs')::BIGINT AS observed, round(100.0 * count(*) FILTER (WHERE src = 'obs') / count(*), 2) AS observed_pct, count(*) FILTER (WHERE v < 15 OR v > 120)::BIGINT AS clamped FROM z""")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion_field.coverage(_field(spark, sf_dir))


@query("""SELECT CASE WHEN s_acctbal IS NULL THEN 'unknown' ELSE turn END AS turn, count(*)::BIGINT AS n FROM (SELECT *, """ + _LABEL.format("d") + """ AS turn FROM (SELECT *, """ + _WRAP.format("s_acctbal - s_nationkey * 30.0") + """ AS d FROM supplier)) GROUP BY 1""")
def turn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(turn_label(F.col("s_nationkey") * 30.0, F.col("s_acctbal")).alias("turn")).groupBy("turn").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type AS class, (epoch_us(ts) // 3600000000)::BIGINT AS hour, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs

    e = read(spark, sf_dir, "events").select(F.expr("timestamp_micros(unix_micros(cast(ts as timestamp)))").alias("ts"), F.col("event_type").alias("class"))
    return jobs.counts(e, "1 hour").select("class", F.floor(F.unix_micros("start") / 3_600_000_000).alias("hour"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 7200000000 - 1 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS track_id, epoch_us(min(ts))::BIGINT AS start_us, count(*)::BIGINT AS n FROM i GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs

    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("track_id"))
    return jobs.sessions(e, "2 hours").select("track_id", F.unix_micros("start").alias("start_us"), "n")


@query("""SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def host_sql_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..service import run

    read(spark, sf_dir, "orders").createOrReplaceTempView("kerbside_orders")
    return run(spark, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM kerbside_orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")


@query("""SELECT c_nationkey, c_custkey, r::INT AS r FROM (SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3""")
def host_sql_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..service import run

    read(spark, sf_dir, "customer").createOrReplaceTempView("kerbside_customer")
    return run(spark, "WITH t AS (SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM kerbside_customer) SELECT c_nationkey, c_custkey, r FROM t WHERE r <= 3")


@query("""(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT r_regionkey FROM region""")
def host_sql_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..service import run

    for t in ("customer", "supplier", "region"):
        read(spark, sf_dir, t).createOrReplaceTempView(f"kerbside_{t}")
    return run(spark, "(SELECT c_nationkey AS k FROM kerbside_customer INTERSECT SELECT s_nationkey FROM kerbside_supplier) EXCEPT SELECT r_regionkey FROM kerbside_region")


@query("""SELECT d.event_type AS cctv_id, c.n_name AS name, count(*)::BIGINT AS n FROM events d JOIN nation c ON c.n_nationkey = d.user_id % 25 GROUP BY 1, 2""")
def host_sql_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..service import run

    read(spark, sf_dir, "events").createOrReplaceTempView("kerbside_events")
    read(spark, sf_dir, "nation").createOrReplaceTempView("kerbside_nation")
    return run(spark, "SELECT d.event_type AS cctv_id, c.n_name AS name, count(*) AS n FROM kerbside_events d JOIN kerbside_nation c ON c.n_nationkey = d.user_id % 25 GROUP BY 1, 2")

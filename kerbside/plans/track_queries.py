"""Queries of the track algorithms, whose results SQL cannot express; tests hold them against plain versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, lane_graph, matching, sequences, smoother, tracking
from ..operators.graph import cut, shared_dir
from . import tables
from .tables import DRIVES, ROADS, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql):
    """Registers a query, with its SQL where it is given."""
    if callable(sql):
        QUERIES[sql.__name__] = sql
        return sql

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as points near a straight road: each user goes along it at a speed of their own."""
    e = read(spark, sf_dir, "events")
    k = F.row_number().over(sequences.window(["user_id"], ["ts", "event_id"]))
    return e.select(F.col("event_type").alias("cctv_id"), F.col("user_id").alias("track_id"), k.alias("frame"), (k * (1.0 + F.col("user_id") % 5 * 0.2)).alias("x"), (F.col("value") % 7 - 3.0).alias("y"), F.lit("car").alias("class"), (0.2 + F.pmod("event_id", F.lit(80)) / 100.0).alias("confidence"), F.lit(0.0).alias("heading"), F.lit(20.0).alias("speed_kmh"))


@query
def track_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoother.smooth(_points(spark, sf_dir).select("track_id", "frame", "x", "y"), ["track_id"], 10.0)


@query
def ground_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a detection.  A camera sees five users, so that a frame holds at most five of them, each at a speed of its own."""
    rows = _points(spark, sf_dir).withColumn("cctv_id", F.concat(F.lit("cam-"), F.floor(F.col("track_id") / 5)))
    # the rows are few bytes but much work: as many tasks as there are shuffle partitions, not as few as their size asks for
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cctv_id")
    return tracking.track(rows.select("cctv_id", "frame", "x", "y", "confidence", "class"), 10.0)


def lanes(spark: SparkSession, sf_dir: str) -> lane_graph.Graph:
    """The roads as the lane graph of one camera's surroundings: 25 junctions."""
    links = tables.roads(spark, sf_dir)
    return lane_graph.Graph.from_rows(links.collect(), lane_graph.topology(links).collect())


def driven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drives as detections of cameras that see five tracks each, some of them unsure."""
    d = tables.drives(spark, sf_dir)
    return d.select(F.concat(F.lit("cam-"), F.floor(F.col("track_id") / 5).cast("string")).alias("cctv_id"), F.col("frame").cast("long").alias("frame"), "x", "y", (0.3 + F.col("event_id") % 7 / 10.0).alias("confidence"), F.lit("car").alias("class"))


@query
def ground_tracker_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker on a lane graph: tracks coast along lanes."""
    return tracking.track(driven(spark, sf_dir), 1.0, graph=lanes(spark, sf_dir))


def _streamed(spark: SparkSession, rows: DataFrame, job, batches: int = 3) -> DataFrame:
    """What `job` makes of `rows` as a stream: their frames come in so many parts, each written by all tasks and then drained as one micro-batch."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = cut(rows)
    last = rows.agg(F.max("frame")).first()[0] or 0
    for k in range(batches):
        low, high = k * (last + 1) // batches, (k + 1) * (last + 1) // batches
        rows.where((F.col("frame") >= low) & (F.col("frame") < high)).write.mode("append").parquet(f"{folder}/in")
        out = job(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query
def stream_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`track_smoother` as a stream with keyed state for each track."""
    from ..streaming import jobs

    rows = _points(spark, sf_dir).select("cctv_id", F.col("track_id").cast("string").alias("track_id"), F.col("frame").cast("long").alias("frame"), "x", "y")
    return _streamed(spark, rows.withColumn("cctv_id", F.lit("cam")), lambda r: jobs.smooth(r, 10.0, idle_ms=None))


@query
def stream_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ground_tracker` as a stream with keyed state for each track of each camera."""
    from ..streaming import jobs

    rows = _points(spark, sf_dir).withColumn("cctv_id", F.concat(F.lit("cam-"), F.floor(F.col("track_id") / 5).cast("string")))
    return _streamed(spark, rows.select("cctv_id", F.col("frame").cast("long").alias("frame"), "x", "y", "confidence", "class"), lambda r: jobs.track(r, 10.0, idle_ms=None))


@query
def overlap_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box is a detection; the boxes of an order are a frame of each camera that sees some of them."""
    b = tables.boxes(spark, sf_dir).withColumn("frame", F.col("l_orderkey"))
    return tracking.track_by_overlap(b.select("cctv_id", "frame", "x1", "y1", "x2", "y2"))


_DIRECTED = f"""d AS ({DRIVES}), l AS ({ROADS}), m AS (SELECT *, CASE WHEN speed_kmh >= 5 THEN radians(heading) WHEN sqrt(power(sc, 2) + power(ss, 2)) > 1e-9 THEN atan2(ss, sc) END AS dir FROM (
  SELECT *, sum(CASE WHEN speed_kmh >= 5 THEN cos(radians(heading)) END) OVER (PARTITION BY track_id) AS sc, sum(CASE WHEN speed_kmh >= 5 THEN sin(radians(heading)) END) OVER (PARTITION BY track_id) AS ss FROM d)),
 t AS (SELECT *, least(1.0, greatest(0.0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / (len * len))) AS t FROM m, l),
 f AS (SELECT *, ax + t * (bx - ax) AS fx, ay + t * (b_y - ay) AS fy, ((bx - ax) * (y - ay) - (b_y - ay) * (x - ax)) / len AS d FROM t),
 g AS (SELECT *, sqrt(power(x - fx, 2) + power(y - fy, 2)) AS dist, CASE WHEN dir IS NULL THEN 0.0 WHEN directed THEN (1 - cos(atan2(b_y - ay, bx - ax) - dir)) / 2 ELSE (1 - abs(cos(atan2(b_y - ay, bx - ax) - dir))) / 2 END AS pen FROM f)"""


@query(f"""WITH {_DIRECTED}, k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(d), link_id) AS r FROM g WHERE dist <= 25), b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(d) + 8.0 * pen, 9), link_id) AS r2 FROM k WHERE r <= 6)
 SELECT m.event_id, b.link_id, round(t * len, 6) AS s, round(b.d, 6) AS d FROM m LEFT JOIN b ON b.event_id = m.event_id AND r2 = 1""")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.match_tracks(tables.drives(spark, sf_dir), tables.roads(spark, sf_dir), ["track_id"], "greedy")
    return out.select("event_id", "link_id", F.round("s", 6).alias("s"), F.round("d", 6).alias("d"))


# The most likely path by two recursions: scores of a point's options from those of the point before, in whole millionths, then back along the best ones.
_VITERBI = f"""WITH RECURSIVE {_DIRECTED}, k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(d), 9), link_id) AS r FROM g WHERE dist <= 25),
 o AS MATERIALIZED (SELECT event_id, track_id, frame, x, y, r, link_id, len, t * len AS s, d, round(1e6 * (-0.5 * power(d / 2.0, 2) - ln(sqrt(2 * pi()) * 2.0) - 2.0 * pen))::BIGINT AS e FROM k WHERE r <= 6),
 p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS n FROM (SELECT event_id, track_id, frame, x, y, list(e ORDER BY r) AS emit FROM o GROUP BY ALL)),
 ed AS (SELECT a.link_id AS src, b.link_id AS dst, a.directed FROM l a JOIN l b ON a.b_node = b.a_node AND a.link_id <> b.link_id), e AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed WHERE NOT directed),
 w(src, dst, gap) AS (SELECT src, dst, 0.0::DOUBLE FROM e UNION SELECT w.src, e.dst, (w.gap + l.len)::DOUBLE FROM w JOIN e ON e.src = w.dst JOIN l ON l.link_id = w.dst WHERE w.gap + l.len <= 300),
 gaps AS MATERIALIZED (SELECT src, dst, min(gap) AS gap FROM w WHERE src <> dst GROUP BY 1, 2),
 mv AS (SELECT q.track_id, q.n, b.r AS rb, a.r AS ra, sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2)) AS straight, CASE WHEN a.link_id = b.link_id THEN CASE WHEN b.s - a.s >= -1 THEN abs(b.s - a.s) END ELSE greatest(0.0, a.len - a.s) + gap + b.s END AS route
  FROM p JOIN p q ON q.track_id = p.track_id AND q.n = p.n + 1 JOIN o a ON a.event_id = p.event_id JOIN o b ON b.event_id = q.event_id LEFT JOIN gaps ON src = a.link_id AND dst = b.link_id),
 rowed AS (SELECT track_id, n, rb, list(round(1e6 * (-abs(straight - route) / 4.0 - ln(4.0)))::BIGINT ORDER BY ra) AS m FROM mv GROUP BY 1, 2, 3),
 steps AS MATERIALIZED (SELECT track_id, n, emit, m FROM (SELECT track_id, n, list(m ORDER BY rb) AS m FROM rowed GROUP BY 1, 2) JOIN p USING (track_id, n)),
 fwd(track_id, n, sc, bk) AS (SELECT track_id, n, emit, list_transform(emit, lambda v: NULL::BIGINT) FROM p WHERE n = 1
  UNION ALL SELECT track_id, n, CASE WHEN list_max(best) IS NULL THEN emit ELSE list_transform(range(1, len(emit) + 1), lambda i: best[i] + emit[i]) END, list_transform(tot, lambda v: CASE WHEN list_max(v) IS NOT NULL THEN list_position(v, list_max(v))::BIGINT END)
   FROM (SELECT *, list_transform(tot, lambda v: list_max(v)) AS best FROM (SELECT fwd.track_id, steps.n, emit, list_transform(m, lambda v: list_transform(range(1, len(v) + 1), lambda i: sc[i] + v[i])) AS tot FROM fwd JOIN steps ON steps.track_id = fwd.track_id AND steps.n = fwd.n + 1))),
 fw AS MATERIALIZED (SELECT * FROM fwd),
 b(track_id, n, pick) AS (SELECT track_id, n, list_position(sc, list_max(sc))::BIGINT FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC) AS z FROM fw) WHERE z = 1
  UNION ALL SELECT b.track_id, y.n, coalesce(fw.bk[b.pick], list_position(y.sc, list_max(y.sc)))::BIGINT FROM b JOIN fw ON fw.track_id = b.track_id AND fw.n = b.n JOIN fw y ON y.track_id = b.track_id AND y.n = b.n - 1)
 SELECT m.event_id, o.link_id, round(o.s, 6) AS s, round(o.d, 6) AS d FROM m LEFT JOIN p ON p.event_id = m.event_id LEFT JOIN b ON b.track_id = p.track_id AND b.n = p.n LEFT JOIN o ON o.event_id = p.event_id AND o.r = b.pick"""


# That path kept to its longest chain: chains by running counts of breaks, the non-decreasing fit by its max-min formula, progress by windows.
_LOCK = (
    _VITERBI[: _VITERBI.index(" SELECT m.event_id, o.link_id, round(o.s, 6)")]
    + """,
 v AS MATERIALIZED (SELECT p.track_id, p.n, p.event_id, p.x, p.y, o.link_id, o.s, o.d, count(*) OVER (PARTITION BY p.track_id) AS rows_ FROM p JOIN b ON b.track_id = p.track_id AND b.n = p.n JOIN o ON o.event_id = p.event_id AND o.r = b.pick),
 pa AS (SELECT *, lag(link_id) OVER (PARTITION BY track_id ORDER BY n) AS was FROM v WHERE rows_ > 1), pc AS (SELECT pa.*, sum((was IS NOT NULL AND gaps.gap IS NULL)::INT) OVER (PARTITION BY track_id ORDER BY n) AS piece FROM pa LEFT JOIN gaps ON src = was AND dst = link_id WHERE was IS NULL OR was <> link_id),
 pn AS (SELECT *, count(*) OVER (PARTITION BY track_id, piece) AS c FROM pc), pb AS (SELECT *, first_value(piece) OVER (PARTITION BY track_id ORDER BY c DESC, piece) AS best FROM pn),
 ch AS MATERIALIZED (SELECT *, coalesce(sum(len) OVER (PARTITION BY track_id ORDER BY first_n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT track_id, link_id, min(n) AS first_n FROM pb WHERE piece = best GROUP BY 1, 2) JOIN l USING (link_id)),
 ft AS (SELECT v.track_id, v.n, first_n, off, len, least(1.0, greatest(0.0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / (len * len))) AS t, ((bx - ax) * (y - ay) - (b_y - ay) * (x - ax)) / len AS lat, x, y, ax, ay, bx, b_y FROM v JOIN ch USING (track_id) WHERE rows_ > 1),
 fo AS (SELECT *, row_number() OVER (PARTITION BY track_id, n ORDER BY round(abs(lat), 6), sqrt(power(x - ax - t * (bx - ax), 2) + power(y - ay - t * (b_y - ay), 2)), first_n) AS z FROM ft),
 al AS MATERIALIZED (SELECT track_id, n, off + t * len AS a, lat, sum(off + t * len) OVER (PARTITION BY track_id ORDER BY n) AS total FROM fo WHERE z = 1),
 me AS (SELECT i.track_id, i.n AS i, j.n AS j, (j.total - i.total + i.a) / (j.n - i.n + 1) AS mean FROM al i JOIN al j ON j.track_id = i.track_id AND j.n >= i.n),
 mi AS (SELECT track_id, i, j, min(mean) OVER (PARTITION BY track_id, i ORDER BY j DESC) AS low FROM me), iso AS MATERIALIZED (SELECT track_id, j AS n, max(low) AS a FROM mi GROUP BY 1, 2),
 st AS (SELECT *, CASE WHEN n > min(n) OVER (PARTITION BY track_id) THEN greatest(0.0, a - lag(a) OVER (PARTITION BY track_id ORDER BY n)) END AS step, count(*) OVER (PARTITION BY track_id) AS c, first_value(a) OVER (PARTITION BY track_id ORDER BY n) AS a0 FROM iso),
 sm AS (SELECT *, (sum(step) OVER (PARTITION BY track_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) + greatest(0, 6 - n) * min_by(step, n) OVER t + greatest(0, n + 4 - c) * max_by(step, n) OVER t) / 9 AS smooth FROM st WHERE step IS NOT NULL WINDOW t AS (PARTITION BY track_id)),
 sc AS (SELECT *, CASE WHEN sum(step) OVER t > 1e-9 AND sum(smooth) OVER t > 1e-9 THEN sum(step) OVER t / sum(smooth) OVER t ELSE 1.0 END AS scale, sum(smooth) OVER (PARTITION BY track_id ORDER BY n) AS run FROM sm WINDOW t AS (PARTITION BY track_id)),
 pr AS MATERIALIZED (SELECT st.track_id, st.n, CASE WHEN st.c < 3 THEN st.a ELSE st.a0 + coalesce(run * scale, 0) END AS a FROM st LEFT JOIN sc ON sc.track_id = st.track_id AND sc.n = st.n),
 pl AS (SELECT pr.track_id, pr.n, arg_max(link_id, first_n) AS link_id, max_by(greatest(0.0, least(len, a - off)), first_n) AS s FROM pr JOIN ch ON ch.track_id = pr.track_id AND (off = 0 OR round(off, 9) < round(a, 9)) GROUP BY 1, 2)
 SELECT m.event_id, coalesce(pl.link_id, v.link_id) AS link_id, round(coalesce(pl.s, v.s), 6) AS s, round(coalesce(al.lat, v.d), 6) AS d FROM m LEFT JOIN v ON v.event_id = m.event_id LEFT JOIN pl ON pl.track_id = v.track_id AND pl.n = v.n LEFT JOIN al ON al.track_id = v.track_id AND al.n = v.n"""
)


def _path(spark: SparkSession, sf_dir: str, method: str, chunk: int | None = matching.CHUNK) -> DataFrame:
    out = matching.match_tracks(tables.drives(spark, sf_dir), tables.roads(spark, sf_dir), ["track_id"], method, chunk=chunk)
    return out.select("event_id", "link_id", F.round("s", 6).alias("s"), F.round("d", 6).alias("d"))


@query(_VITERBI)
def viterbi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(spark, sf_dir, "viterbi")


@query(_VITERBI)
def viterbi_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`viterbi_match` with tracks cut in stretches of ten frames, as those are that exceed a task."""
    return _path(spark, sf_dir, "viterbi", 10)


@query(_LOCK)
def lane_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(spark, sf_dir, "lock")


@query(_LOCK)
def lane_lock_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lane_lock` with tracks cut in stretches of ten frames, as those are that exceed a task."""
    return _path(spark, sf_dir, "lock", 10)


@query(f"""WITH {_DIRECTED}, k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, link_id) AS r FROM g WHERE dist <= 20), b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(dist + 8.0 * pen, 9), link_id) AS r2 FROM k WHERE r <= 6),
 j AS (SELECT m.event_id, m.track_id, b.link_id, b.directed, b.d, b.fx, b.fy, b.bx, b.ax, b.b_y, b.ay, cos(atan2(b.b_y - b.ay, b.bx - b.ax) - b.dir) AS c FROM m LEFT JOIN b ON b.event_id = m.event_id AND r2 = 1),
 o AS (SELECT *, (CASE WHEN d < 0 THEN -1.0 ELSE 1.0 END) * (least(3.0, greatest(0.0, round_even((abs(d) - 1.75) / 3.5, 0))) * 3.5 + 1.75) AS off,
  coalesce(2 * count(*) FILTER (WHERE directed) OVER w > count(link_id) OVER w AND avg(c) FILTER (WHERE directed) OVER w < -0.3, false) AS back, coalesce(sum(sign(c)) FILTER (WHERE NOT directed) OVER w < 0, false) AS votes FROM j WINDOW w AS (PARTITION BY track_id)),
 h AS (SELECT *, degrees(atan2(b_y - ay, bx - ax)) + CASE WHEN CASE WHEN directed THEN back ELSE votes END THEN 180.0 ELSE 0.0 END AS head FROM o)
 SELECT event_id, link_id, CASE WHEN d IS NOT NULL THEN off END AS lane_offset_m, round(fx - off * sin(atan2(b_y - ay, bx - ax)), 6) AS snap_x, round(fy + off * cos(atan2(b_y - ay, bx - ax)), 6) AS snap_y, round(head - 360.0 * floor((head + 180.0) / 360.0), 6) AS snap_heading, back AS wrong_way FROM h""")
def lane_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.drives(spark, sf_dir).withColumn("row_id", F.col("event_id"))
    out = matching.snap(rows, tables.roads(spark, sf_dir), ["track_id"], lane_width=3.5)
    return out.select("event_id", "link_id", "lane_offset_m", *(F.round(c, 6).alias(c) for c in ("snap_x", "snap_y", "snap_heading")), "wrong_way")


@query("""WITH p AS (SELECT user_id AS track_id, k AS frame, k * (1.0 + user_id % 5 * 0.2::DOUBLE) AS x, value % 7 - 3.0 AS y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS k FROM events)),
 w AS (SELECT *, coalesce(lag(x) OVER t, x) AS x0, coalesce(lag(y) OVER t, y) AS y0, coalesce(lead(x) OVER t, x) AS x1, coalesce(lead(y) OVER t, y) AS y1 FROM p WINDOW t AS (PARTITION BY track_id ORDER BY frame)) SELECT track_id, frame, round(x, 6) AS x, round(y, 6) AS y, round(CASE WHEN frame % 4 = 0 THEN 0.0::DOUBLE ELSE degrees(atan2(y1 - y0, x1 - x0)) END, 6) AS heading FROM w""")
def heading_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir).select("track_id", "frame", "x", "y", F.when(F.col("frame") % 4 == 0, F.col("heading")).alias("heading"))
    return sequences.headings(rows, ["track_id"], ["frame"]).withColumns({c: F.round(c, 6) for c in ("x", "y", "heading")})


@query("""WITH e AS (SELECT user_id AS t, CASE WHEN event_type <> 'error' THEN user_id * 10 + event_id % 3 END AS p FROM events), c AS (SELECT t, p, count(*) AS n FROM e WHERE p IS NOT NULL GROUP BY 1, 2), b AS (SELECT t, max(n) AS n FROM c GROUP BY 1)
 SELECT round(2.0 * (SELECT sum(n) FROM b) / ((SELECT count(*) FROM e) + (SELECT count(p) FROM e)), 9) AS idf1""")
def identity_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("frame"), F.when(F.col("event_type") != "error", F.col("user_id") * 10 + F.col("event_id") % 3).alias("tracked_id"))
    n, p = e.count(), e.where("tracked_id is not null").count()
    return spark.createDataFrame([(round(evaluation.identity_f1(e, n, p), 9),)], "idf1 double")


_SHARED = "SELECT user_id AS t, CASE WHEN event_type <> 'error' THEN user_id // 3 * 3 + (user_id + CASE event_id % 7 WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN event_id // 7 % 3 ELSE user_id // 3 % 2 END) % 3 END AS p FROM events"


@query(f"""WITH e AS ({_SHARED}), c AS (SELECT t // 3 AS g, t % 3 AS i, p % 3 AS j, count(*) AS n FROM e WHERE p IS NOT NULL GROUP BY ALL),
 m AS (SELECT g, {", ".join(f"coalesce(sum(n) FILTER (i = {i} AND j = {j}), 0) AS n{i}{j}" for i in range(3) for j in range(3))} FROM c GROUP BY 1),
 b AS (SELECT greatest({", ".join(f"n0{a} + n1{b} + n2{c}" for a in range(3) for b in range(3) for c in range(3) if len({a, b, c}) == 3)}) AS n FROM m)
 SELECT round(2.0 * (SELECT sum(n) FROM b) / ((SELECT count(*) FROM e) + (SELECT count(p) FROM e)), 9) AS idf1""")
def identity_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDF1 where three tracks share three predicted ids, so that the best for each is not the best for all."""
    u, k = F.col("user_id"), F.col("event_id")
    shift = F.when(k % 7 == 0, 1).when(k % 7 == 3, 2).when(k % 7 == 5, F.floor(k / 7) % 3).otherwise(F.floor(u / 3) % 2)
    e = read(spark, sf_dir, "events").select(u.alias("track_id"), F.col("event_id").alias("frame"), F.when(F.col("event_type") != "error", F.floor(u / 3) * 3 + (u + shift) % 3).alias("tracked_id"))
    n, p = e.count(), e.where("tracked_id is not null").count()
    return spark.createDataFrame([(round(evaluation.identity_f1(e, n, p), 9),)], "idf1 double")


@query
def detection_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    truth = b.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("track_id"), "x1", "y1", "x2", "y2")
    found = b.select(F.col("l_orderkey").alias("frame"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tracked_id"), (F.col("l_orderkey") % 90 / 100.0).alias("confidence"), (F.col("x1") + F.col("l_orderkey") % 30).alias("x1"), "y1", (F.col("x2") + F.col("l_orderkey") % 30).alias("x2"), "y2")
    return evaluation.greedy_matches(truth, found)

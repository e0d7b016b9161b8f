"""Queries of geometry, calibration, evaluation, alignment and the lane graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles, geodesy, geometry
from ..operators import align, calibrate, evaluation, lane_graph, masks, pipelines, spatial_join
from . import tables
from .tables import BOXES, ROADS, read

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


#: A camera for the geometry queries: ground metres from pixels, camera at (3, -4), 9 m high.
H = [0.05, 0.002, -20.0, 0.001, -0.08, 60.0, 0.0001, 0.001, 1.0]
CX, CY, CZ = 3.0, -4.0, 9.0
_W = "(0.0001 * {u} + 0.001 * {v} + 1.0)"
_X = "((0.05 * {u} + 0.002 * {v} - 20.0) / " + _W + ")"
_Y = "((0.001 * {u} - 0.08 * {v} + 60.0) / " + _W + ")"
_RX = "(3.0 + (" + _X + " - 3.0) * ((9.0 - {h}) / 9.0))"
_RY = "(-4.0 + (" + _Y + " + 4.0) * ((9.0 - {h}) / 9.0))"


def _at(x: str, **k: str) -> str:
    return x.format(**k)


_UVH = {"u": "(x1 + x2) / 2.0", "v": "y2", "h": "1.5"}


@query(f"""WITH b AS ({BOXES}) SELECT l_orderkey, l_linenumber, round({_at(_RX, **_UVH)}, 6) AS x, round({_at(_RY, **_UVH)}, 6) AS y FROM b""")
def homography_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    x, y = geometry.contact_point(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.lit(1.5), H, CX, CY, CZ)
    return b.select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"""WITH b AS ({BOXES}) SELECT l_orderkey, l_linenumber, round((x1 + x2) / 2.0, 6) AS u, round(y2, 6) AS v FROM b""")
def projection_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    u, v = (F.col("x1") + F.col("x2")) / 2.0, F.col("y2")
    x, y = geometry.pixel_to_ground(H, u, v, F.lit(1.2), CX, CY, CZ)
    p, q = geometry.ground_to_pixel(geometry.inverse3(H), x, y, F.lit(1.2), CX, CY, CZ)
    return b.select("l_orderkey", "l_linenumber", F.round(p, 6).alias("u"), F.round(q, 6).alias("v"))


_FLOOR = [("2.0", "0.9"), ("2.0", "-0.9"), ("-2.0", "-0.9"), ("-2.0", "0.9")]


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(l_quantity + {a} * cos(radians(l_tax * 1000)) - ({b}) * sin(radians(l_tax * 1000)), 6) AS x{k}, round(l_discount * 100 + {a} * sin(radians(l_tax * 1000)) + ({b}) * cos(radians(l_tax * 1000)), 6) AS y{k}" for k, (a, b) in enumerate(_FLOOR)) + " FROM lineitem")
def floor_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    box = geometry.floor_box(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 1000, F.lit(4.0), F.lit(1.8))
    return li.withColumn("b", box).select("l_orderkey", "l_linenumber", *(F.round(F.col("b")[k][i], 6).alias(f"{n}{k}") for k in range(4) for i, n in enumerate("xy")))


def _box_pixels() -> str:
    i = geometry.inverse3(H)
    w = f"({i[6]} * x + {i[7]} * y + {i[8]})"
    return f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 + 20.0 AS y, radians(l_tax * 1000) AS t FROM lineitem), c AS (SELECT *, n, CASE WHEN n % 4 < 2 THEN 2.0 ELSE -2.0 END AS a, CASE WHEN n % 4 IN (0, 3) THEN 0.9 ELSE -0.9 END AS s FROM b, (SELECT unnest(range(8))::INT AS n)),
 p AS (SELECT l_orderkey, l_linenumber, n, x + a * cos(t) - s * sin(t) AS x, y + a * sin(t) + s * cos(t) AS y FROM c), q AS (SELECT l_orderkey, l_linenumber, n, CASE WHEN n < 4 THEN x ELSE {CX} + (x - {CX}) * ({CZ} / ({CZ} - 1.5)) END AS x, CASE WHEN n < 4 THEN y ELSE {CY} + (y - ({CY})) * ({CZ} / ({CZ} - 1.5)) END AS y FROM p)
 SELECT l_orderkey, l_linenumber, n, round(({i[0]} * x + {i[1]} * y + {i[2]}) / {w}, 4) AS u, round(({i[3]} * x + {i[4]} * y + {i[5]}) / {w}, 4) AS v FROM q"""


@query(_box_pixels())
def box_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight pixels of each box, one a row."""
    # outer, as each box has eight; else a filter on their number is pushed below, which computes the box again for each use of its floor
    each = box_3d(spark, sf_dir).select("l_orderkey", "l_linenumber", F.posexplode_outer("pixels").alias("n", "p"))
    return each.select("l_orderkey", "l_linenumber", "n", F.round(F.col("p")[0], 4).alias("u"), F.round(F.col("p")[1], 4).alias("v"))


@query()
def box_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    floor = geometry.floor_box(F.col("l_quantity"), F.col("l_discount") * 100 + 20.0, F.col("l_tax") * 1000, F.lit(4.0), F.lit(1.8))
    return li.withColumn("floor", floor).select("l_orderkey", "l_linenumber", geometry.box_3d(F.col("floor"), F.lit(1.5), geometry.inverse3(H), CX, CY, CZ).alias("pixels"))


def _cov() -> str:
    p = {(i, j): (_at(_RX, u=f"(u + {i})", v=f"(v + {j})", h="0.0"), _at(_RY, u=f"(u + {i})", v=f"(v + {j})", h="0.0")) for i, j in ((0, 0), (1, 0), (0, 1))}
    cols = ", ".join(f"{p[k][0]} AS x{k[0]}{k[1]}, {p[k][1]} AS y{k[0]}{k[1]}" for k in p)
    return f"""WITH b AS (SELECT l_orderkey, l_linenumber, (x1 + x2) / 2.0 AS u, y2 AS v FROM ({BOXES})), p AS (SELECT l_orderkey, l_linenumber, {cols} FROM b),
 j AS (SELECT *, x10 - x00 AS a, x01 - x00 AS b, y10 - y00 AS c, y01 - y00 AS d FROM p), m AS (SELECT *, 9 * (a * a + b * b) AS xx, 9 * (a * c + b * d) AS xy, 9 * (c * c + d * d) AS yy FROM j)"""


@query(_cov() + " SELECT l_orderkey, l_linenumber, round(xx, 6) AS xx, round(xy, 6) AS xy, round(yy, 6) AS yy, round(sqrt((xx + yy) / 2 + sqrt(power(xx - yy, 2) / 4 + xy * xy)), 6) AS sigma FROM m")
def ground_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    c = geometry.with_ground_covariance(b, H, (F.col("x1") + F.col("x2")) / 2.0, F.col("y2"), F.lit(0.0), CX, CY, CZ)
    xx, xy, yy = (F.col(f"c_{n}") for n in ("xx", "xy", "yy"))
    return c.select("l_orderkey", "l_linenumber", *(F.round(v, 6).alias(n) for v, n in ((xx, "xx"), (xy, "xy"), (yy, "yy"), (geometry.largest_sigma(xx, xy, yy), "sigma"))))


@query(f"""WITH b AS (SELECT cctv_id, {_at(_RX, **(_UVH | {"h": "0.0"}))} AS x, {_at(_RY, **(_UVH | {"h": "0.0"}))} AS y FROM ({BOXES})) SELECT cctv_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE sqrt(power(x - 3.0, 2) + power(y + 4.0, 2)) > 25)::BIGINT AS rejected FROM b GROUP BY 1""")
def projection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    x, y = geometry.contact_point(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.lit(0.0), H, CX, CY, CZ)
    placed = b.withColumns({"x": x, "y": y, "cam_x": F.lit(CX), "cam_y": F.lit(CY), "c_xx": F.lit(1.0), "c_xy": F.lit(0.0), "c_yy": F.lit(1.0)})
    return pipelines.reject_far(placed, 25.0).groupBy("cctv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("proj_rejected").alias("rejected"))


@query(f"""WITH b AS ({BOXES}) SELECT y2 AS v, round(abs({_at(_Y, u="500.0", v="(y2 + 1)")} - {_at(_Y, u="500.0", v="y2")}), 6) AS metres_per_px FROM (SELECT DISTINCT y2 FROM b)""")
def longitudinal_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.boxes(spark, sf_dir).select(F.col("y2").alias("v")).distinct()
    a = geometry.project(H, F.lit(500.0), F.col("v"))[1]
    b = geometry.project(H, F.lit(500.0), F.col("v") + 1.0)[1]
    return v.select("v", F.round(F.abs(b - a), 6).alias("metres_per_px"))


@query(f"""WITH b AS ({BOXES}), a AS (SELECT * FROM b WHERE l_linenumber = 1), c AS (SELECT * FROM b WHERE l_linenumber > 1),
 i AS (SELECT a.l_orderkey, c.l_linenumber, greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS m, (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS s FROM a JOIN c USING (l_orderkey))
 SELECT l_orderkey, l_linenumber AS p_l_linenumber, round(m / (s - m), 6) AS iou FROM i WHERE m / (s - m) >= 0.05""")
def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    pairs = evaluation.overlaps(b.where("l_linenumber = 1").drop("l_linenumber"), b.where("l_linenumber > 1"), 0.05, ("l_orderkey",))
    return pairs.select("l_orderkey", "p_l_linenumber", F.round("iou", 6).alias("iou"))


@query("""WITH m AS (SELECT d.n_chars::DOUBLE AS confidence, l.quality = 1 AS tp, l.doc_id FROM labels l JOIN documents d USING (doc_id)), n AS (SELECT count(*) FILTER (WHERE tp) AS t FROM m),
 c AS (SELECT tp, sum(tp::INT) OVER w AS s, row_number() OVER w AS k FROM m WINDOW w AS (ORDER BY confidence DESC, tp DESC ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT s::DOUBLE / greatest(t, 1) AS recall, s::DOUBLE / k AS precision FROM c, n), g AS (SELECT unnest(range(101)) AS i),
 b AS (SELECT i, coalesce(max(precision), 0) AS p FROM g LEFT JOIN r ON floor(round(recall * 100, 9)) >= i GROUP BY 1) SELECT round(avg(p), 6) AS ap FROM b""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select(F.col("n_chars").cast("double").alias("confidence"), (F.col("quality") == 1).alias("tp"))
    return evaluation.average_precision(evaluation.precision_recall(m, m.where("tp").count())).select(F.round("ap", 6).alias("ap"))


@query("""WITH m AS (SELECT user_id AS track_id, event_id AS frame, CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 3 END AS pid FROM events),
 p AS (SELECT *, lag(pid) OVER w AS prev, row_number() OVER w AS r FROM m WINDOW w AS (PARTITION BY track_id ORDER BY frame))
 SELECT count(*) FILTER (WHERE r > 1 AND pid IS NOT NULL AND pid IS DISTINCT FROM prev)::BIGINT AS switches FROM p""")
def identity_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("frame"), F.when(F.col("event_type") != "error", F.col("event_id") % 3).alias("tracked_id"))
    return evaluation.switches(e)


@query("""WITH s AS (SELECT user_id, avg((event_type <> 'error')::INT) AS share FROM events GROUP BY 1) SELECT count(*)::BIGINT AS tracks, count(*) FILTER (WHERE share >= 0.8)::BIGINT AS mostly_tracked, count(*) FILTER (WHERE share < 0.2)::BIGINT AS mostly_lost FROM s""")
def track_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("tracked_id"))
    return evaluation.track_hits(e)


@query("""SELECT s_suppkey, round(atan2(s_acctbal - 100, s_nationkey - 10) / pi() * 180, 6) AS bearing, round((90 - atan2(s_acctbal - 100, s_nationkey - 10) / pi() * 180 + 360) % 360, 6) AS compass FROM supplier""")
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = angles.bearing(F.col("s_nationkey") - 10, F.col("s_acctbal") - 100)
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.round(b, 6).alias("bearing"), F.round(angles.to_compass(b), 6).alias("compass"))


@query("""SELECT s_suppkey, round(6378137.0 * radians(s_nationkey + 110.0), 4) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(s_acctbal / 200.0) / 2)), 4) AS y,
 floor((s_nationkey + 110.0 + 180.0) / 360.0 * 16384.0)::BIGINT AS col, floor((1.0 - ln(tan(radians(s_acctbal / 200.0)) + 1.0 / cos(radians(s_acctbal / 200.0))) / pi()) / 2.0 * 16384.0)::BIGINT AS row FROM supplier""")
def mercator_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("s_nationkey") + 110.0, F.col("s_acctbal") / 200.0
    x, y = geodesy.to_mercator(lon, lat)
    c, r = geodesy.tile(lon, lat, 14)
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), c.alias("col"), r.alias("row"))


@query("""SELECT s_suppkey, round(s_nationkey / 10.0 + 127.0, 7) AS lon, round(s_acctbal / 1000.0 + 30.0, 7) AS lat FROM supplier""")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = geodesy.to_utm(F.col("s_nationkey") / 10.0 + 127.0, F.col("s_acctbal") / 1000.0 + 30.0, 52)
    lon, lat = geodesy.from_utm(e, n, 52)
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


_CIRCLE = "sqrt(power((a.s_nationkey - b.s_nationkey) / 100.0 * 88800.0, 2) + power((a.s_acctbal - b.s_acctbal) / 10000.0 * 111000.0, 2))"


@query(f"""SELECT a.s_suppkey, count(*)::BIGINT AS n, round(min({_CIRCLE}), 4) AS nearest FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey WHERE {_CIRCLE} <= 2000 GROUP BY 1""")
def coverage_per_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") / 100.0 * 88800.0).alias("x"), (F.col("s_acctbal") / 10000.0 * 111000.0).alias("y"))
    return spatial_join.within_distance(s, s, 2000.0).where("s_suppkey <> r_s_suppkey").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("distance"), 4).alias("nearest"))


_POLYGON = [(0.0, 0.0), (40.0, 5.0), (50.0, 40.0), (20.0, 30.0), (5.0, 45.0)]


def _inside() -> str:
    parts = [f"((({ay} > y) <> ({by} > y)) AND x < ({bx - ax}) * (y - ({ay})) / ({by - ay}) + {ax})::INT" for (ax, ay), (bx, by) in zip(_POLYGON, [*_POLYGON[1:], _POLYGON[0]], strict=True)]
    return " + ".join(parts)


@query(f"""SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 500.0 AS y FROM lineitem) WHERE ({_inside()}) % 2 = 1""")
def roi_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").where(geometry.in_polygon(F.col("l_quantity"), F.col("l_discount") * 500.0, _POLYGON)).select("l_orderkey", "l_linenumber")


@query("""WITH c AS (SELECT l_returnflag AS cctv_id, least(6, greatest(1, floor(l_quantity / 10.0) + 1))::INT - 1 AS band, l_extendedprice / 2000.0 AS size FROM lineitem)
 SELECT cctv_id, band, count(*)::BIGINT AS n, round(quantile_cont(size, 0.5), 6) AS median_px, round(quantile_cont(size, 0.1), 6) AS p10_px, CASE WHEN quantile_cont(size, 0.5) >= 24 THEN 'good' WHEN quantile_cont(size, 0.5) >= 12 THEN 'hard' ELSE 'no' END AS verdict FROM c GROUP BY 1, 2 HAVING count(*) >= 10""")
def feasibility_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cctv_id"), F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2000.0).alias("size"))
    return calibrate.feasibility(li, 60.0).select("cctv_id", "band", "n", F.round("median_px", 6).alias("median_px"), F.round("p10_px", 6).alias("p10_px"), "verdict")


@query("""WITH b AS (SELECT l_returnflag AS cctv_id, l_quantity AS rw, l_extendedprice / 1000.0 AS rh FROM lineitem WHERE l_linenumber <= 2 AND l_quantity >= 4 AND l_extendedprice / 1000.0 >= 4),
 m AS (SELECT cctv_id, count(*)::BIGINT AS n, quantile_cont(rw / 25.0, 0.5) AS w, quantile_cont(rh / 40.0, 0.5) AS h FROM b GROUP BY 1) SELECT cctv_id, n, round(w, 6) AS ratio_w, round(h, 6) AS ratio_h, round(w / h, 6) AS anisotropy, w BETWEEN 0.7 AND 1.4 AND h BETWEEN 0.7 AND 1.4 AS ok FROM m""")
def calibration_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cctv_id"), F.when(F.col("l_linenumber") == 1, "Car").when(F.col("l_linenumber") == 2, "van").otherwise("bus").alias("class"), F.col("l_quantity").alias("rw"), (F.col("l_extendedprice") / 1000.0).alias("rh"), F.lit(25.0).alias("pw"), F.lit(40.0).alias("ph"))
    return calibrate.size_ratio(li).select("cctv_id", "n", F.round("ratio_w", 6).alias("ratio_w"), F.round("ratio_h", 6).alias("ratio_h"), F.round("anisotropy", 6).alias("anisotropy"), "ok")


@query("""WITH p AS (SELECT s_nationkey::DOUBLE AS x, floor(s_acctbal / 400.0) AS y FROM supplier), g AS (SELECT a::DOUBLE AS dx, b::DOUBLE AS dy FROM (SELECT unnest(range(-3, 4)) AS a), (SELECT unnest(range(-3, 4)) AS b)),
 f AS (SELECT n_nationkey AS x, m AS y, ((n_nationkey - 12) * (n_nationkey - 12) + (m - 12) * (m - 12)) / 10.0 AS value FROM nation, (SELECT unnest(range(25)) AS m))
 SELECT dx, dy, round(avg(least(6.0, coalesce(value, 6.0))), 6) AS cost FROM p CROSS JOIN g LEFT JOIN f ON f.x = floor(p.x + dx) AND f.y = floor(p.y + dy) GROUP BY 1, 2""")
def grid_search_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surface(spark, sf_dir).select("dx", "dy", F.round("cost", 6).alias("cost"))


def _surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("double").alias("x"), F.floor(F.col("s_acctbal") / 400.0).cast("double").alias("y"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("y"))
    f = n.withColumn("value", ((F.col("x") - 12) * (F.col("x") - 12) + (F.col("y") - 12) * (F.col("y") - 12)) / 10.0)
    return align.surface(p, f, align.grid(spark, 3.0, 1.0), 1.0, 6.0)


@query(ORACLE_SQL["grid_search_surface"].replace("SELECT dx, dy, round(avg", "SELECT round((quantile_cont(cost, 0.5) - min(cost)) / quantile_cont(cost, 0.5), 6) AS contrast FROM (SELECT dx, dy, (avg").replace(", 6) AS cost FROM", ") AS cost FROM") + ")")
def surface_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.contrast(_surface(spark, sf_dir)).select(F.round("contrast", 6).alias("contrast"))


@query("""SELECT round(avg(l_tax * 30), 6) AS mean, round(100.0 * avg((l_tax * 30 < 1)::INT), 4) AS within_1m_pct, round(100.0 * avg((l_tax * 30 < 2)::INT), 4) AS within_2m_pct FROM lineitem""")
def residual_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = align.residuals("d", read(spark, sf_dir, "lineitem").select((F.col("l_tax") * 30).alias("d")))
    return r.select(F.round("mean", 6).alias("mean"), F.round("within_1m_pct", 4).alias("within_1m_pct"), F.round("within_2m_pct", 4).alias("within_2m_pct"))


_LINKS = "SELECT i AS k, 'L' || i AS link_id, i * 10.0 AS ax, (i % 7) * 3.0 AS ay, i * 10.0 + 10.0 AS bx, ((i + 1) % 7) * 3.0 AS y_b FROM (SELECT unnest(range(100)) AS i)"


def _links(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    a = F.struct((i * 10.0).alias("x"), (i % 7 * 3.0).alias("y"))
    b = F.struct((i * 10.0 + 10.0).alias("x"), ((i + 1) % 7 * 3.0).alias("y"))
    return spark.range(100).select(F.concat(F.lit("L"), i.cast("string")).alias("link_id"), F.array(a, b).alias("pts"), F.lit(True).alias("directed"), F.lit(None).cast("int").alias("lane_no"), F.concat(F.lit("N"), i.cast("string")).alias("from_node"), F.concat(F.lit("N"), (i + 1).cast("string")).alias("to_node"))


_FOOT = f"""p AS (SELECT s_suppkey, s_acctbal / 10.0 AS x, s_nationkey * 1.0 AS y FROM supplier), l AS ({_LINKS}),
 t AS (SELECT *, least(1.0, greatest(0.0, ((x - ax) * (bx - ax) + (y - ay) * (y_b - ay)) / (power(bx - ax, 2) + power(y_b - ay, 2)))) AS t, sqrt(power(bx - ax, 2) + power(y_b - ay, 2)) AS len FROM p, l),
 f AS (SELECT *, sqrt(power(x - (ax + t * (bx - ax)), 2) + power(y - (ay + t * (y_b - ay)), 2)) AS dist, ((bx - ax) * (y - ay) - (y_b - ay) * (x - ax)) / len AS d FROM t)"""


@query(f"""WITH {_FOOT} SELECT s_suppkey, link_id, round(t * len, 6) AS s, round(d, 6) AS d, round(dist, 6) AS distance FROM f WHERE dist <= 15""")
def project_to_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10.0).alias("x"), (F.col("s_nationkey") * 1.0).alias("y"))
    return spatial_join.project_onto(p, _links(spark), "s_suppkey", 15.0).select("s_suppkey", "link_id", F.round("s", 6).alias("s"), F.round("d", 6).alias("d"), F.round("distance", 6).alias("distance"))


@query(f"""WITH {_FOOT}, r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(d), link_id) AS r FROM f WHERE dist <= 15) SELECT s_suppkey, link_id, r::INT AS rank FROM r WHERE r <= 2""")
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10.0).alias("x"), (F.col("s_nationkey") * 1.0).alias("y"))
    return spatial_join.candidates(p, _links(spark), "s_suppkey", 15.0, 2).select("s_suppkey", "link_id", "rank")


@query(f"""WITH l AS ({ROADS}) SELECT a.link_id AS src, b.link_id AS dst FROM l a JOIN l b ON a.b_node = b.a_node AND a.link_id <> b.link_id""")
def topology_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lane_graph.by_nodes(lane_graph.ends(tables.roads(spark, sf_dir)))


@query(f"""WITH l AS ({ROADS}) SELECT a.link_id AS src, b.link_id AS dst FROM l a JOIN l b ON a.link_id <> b.link_id AND sqrt(power(a.bx - b.ax, 2) + power(a.b_y - b.ay, 2)) <= 3""")
def topology_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lane_graph.by_distance(lane_graph.ends(tables.roads(spark, sf_dir)), 3.0)


_LENGTHS = "n AS (SELECT n_nationkey AS id, 10.0 + n_nationkey % 7 AS len FROM nation), e AS (SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON b.id = (a.id * 3 + 1) % 25 OR b.id = (a.id + 7) % 25 WHERE a.id <> b.id)"
_GAP = f"""WITH RECURSIVE {_LENGTHS}, g(src, dst, gap) AS (SELECT src, dst, 0.0::DOUBLE FROM e UNION SELECT g.src, e.dst, (g.gap + n.len)::DOUBLE FROM g JOIN e ON e.src = g.dst JOIN n ON n.id = g.dst WHERE g.gap + n.len <= 45),
 m AS (SELECT src, dst, min(gap) AS gap FROM (SELECT * FROM g UNION ALL SELECT id, id, 0.0 FROM n) GROUP BY 1, 2)"""


def _toy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("link_id"), (10.0 + F.col("n_nationkey") % 7).alias("length"))
    a = n.select(F.col("link_id").alias("src"), F.explode(F.array((F.col("link_id") * 3 + 1) % 25, (F.col("link_id") + 7) % 25)).alias("dst")).where("src <> dst").distinct()
    return a, n


@query(_GAP + " SELECT src, dst, gap FROM m")
def graph_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, lengths = _toy(spark, sf_dir)
    return lane_graph.gaps(edges, lengths, 45.0)


@query(_GAP + """, p AS (SELECT s_suppkey, s_nationkey AS a, (s_suppkey % 9)::DOUBLE AS sa, (s_suppkey * 5 % 25)::INT AS b, (s_suppkey % 8)::DOUBLE AS sb FROM supplier),
 r AS (SELECT p.*, CASE WHEN a = b THEN CASE WHEN sb - sa >= -1 THEN abs(sb - sa) END ELSE greatest(0, n.len - sa) + m.gap + sb END AS route FROM p JOIN n ON n.id = a LEFT JOIN m ON m.src = a AND m.dst = b)
 SELECT s_suppkey, route FROM r""")
def route_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, lengths = _toy(spark, sf_dir)
    p = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("link_a"), (F.col("s_suppkey") % 9).cast("double").alias("s_a"), (F.col("s_suppkey") * 5 % 25).cast("int").alias("link_b"), (F.col("s_suppkey") % 8).cast("double").alias("s_b"))
    return lane_graph.route_distance(p, lane_graph.gaps(edges, lengths, 45.0), lengths).select("s_suppkey", "route")


@query(f"""WITH b AS (SELECT DISTINCT cctv_id, frame, unnest(generate_series(floor(x1 / 100)::INT, greatest(floor(x1 / 100), ceil(x2 / 100) - 1)::INT)) AS x, y1, y2 FROM (SELECT cctv_id, l_orderkey AS frame, x1, y1, x2, y2 FROM ({BOXES}))),
 c AS (SELECT DISTINCT cctv_id, frame, x, unnest(generate_series(floor(y1 / 100)::INT, greatest(floor(y1 / 100), ceil(y2 / 100) - 1)::INT)) AS y FROM b), f AS (SELECT l_returnflag AS cctv_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
 SELECT c.cctv_id, x, y, round(count(*) / any_value(n), 6) AS share FROM c JOIN f USING (cctv_id) GROUP BY 1, 2, 3""")
def detection_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir).withColumn("frame", F.col("l_orderkey"))
    return masks.persistence(b, 100).select("cctv_id", "x", "y", F.round("share", 6).alias("share"))


@query("""SELECT l_returnflag AS cctv_id, (l_partkey % 50)::INT AS x, (l_suppkey % 10)::INT AS y, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1, 2, 3""")
def temporal_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cctv_id"), F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 50).cast("int").alias("x"), (F.col("l_suppkey") % 10).cast("int").alias("y"), F.col("l_quantity").alias("value"))
    return masks.temporal_deviation(s).select("cctv_id", "x", "y", F.round("std", 6).alias("std"))


_SEG = "s AS (SELECT s_suppkey AS id, s_nationkey * 4.0 AS x1, s_acctbal / 100.0 AS y1, s_nationkey * 4.0 + 3.0 + s_suppkey % 5 AS x2, s_acctbal / 100.0 + 2.0 + s_suppkey % 3 AS y2 FROM supplier)"


@query(f"""WITH {_SEG}, l AS (SELECT s_n, -(y2 - y1) AS a, x2 - x1 AS b, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS w, -(y2 - y1) * x1 + (x2 - x1) * y1 AS c FROM (SELECT *, (id % 4)::VARCHAR AS s_n FROM s)),
 m AS (SELECT s_n, sum(a * a / w) AS aa, sum(a * b / w) AS ab, sum(b * b / w) AS bb, sum(a * c / w) AS ac, sum(b * c / w) AS bc FROM l GROUP BY 1) SELECT s_n AS cctv_id, round((ac * bb - bc * ab) / (aa * bb - ab * ab), 4) AS vx, round((bc * aa - ac * ab) / (aa * bb - ab * ab), 4) AS vy FROM m""")
def vanishing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    x, y = F.col("s_nationkey") * 4.0, F.col("s_acctbal") / 100.0
    seg = s.select((F.col("s_suppkey") % 4).cast("string").alias("cctv_id"), x.alias("x1"), y.alias("y1"), (x + 3.0 + F.col("s_suppkey") % 5).alias("x2"), (y + 2.0 + F.col("s_suppkey") % 3).alias("y2"))
    return calibrate.vanishing_point(seg).select("cctv_id", F.round("vx", 4).alias("vx"), F.round("vy", 4).alias("vy"))


@query("""SELECT n_regionkey::VARCHAR AS cctv_id, count(*)::BIGINT AS n_points, round((max(n_nationkey) - min(n_nationkey)) / 24.0, 6) AS v_span, greatest(0, count(*) - 4)::BIGINT AS redundancy FROM nation GROUP BY 1""")
def gcp_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("cctv_id"), F.col("n_nationkey").cast("double").alias("v"))
    return calibrate.spread(n, 24.0).select("cctv_id", "n_points", F.round("v_span", 6).alias("v_span"), "redundancy")


@query("""SELECT (s_suppkey % 2)::VARCHAR AS cctv_id, count(*)::BIGINT AS n_points, 0.05::DOUBLE AS h00, 0.002::DOUBLE AS h01, -20.0::DOUBLE AS h02, 0.001::DOUBLE AS h10, -0.08::DOUBLE AS h11, 60.0::DOUBLE AS h12, 0.0001::DOUBLE AS h20, 0.001::DOUBLE AS h21, 1.0::DOUBLE AS h22 FROM supplier GROUP BY 1""")
def homography_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 2).cast("string").alias("cctv_id"), F.col("s_suppkey").alias("n"), (F.col("s_nationkey") * 40.0).alias("u"), (F.col("s_acctbal") / 20.0 + 100.0).alias("v"))
    x, y = geometry.project(H, F.col("u"), F.col("v"))
    fit = calibrate.homographies(p.withColumn("x", x).withColumn("y", y))
    return fit.withColumns({f"h{r}{c}": F.round(f"h{r}{c}", 5) for r in range(3) for c in range(3)})


@query()
def leave_one_out_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 2).cast("string").alias("cctv_id"), F.col("s_suppkey").alias("n"), (F.col("s_nationkey") * 40.0).alias("u"), (F.col("s_acctbal") / 20.0 + 100.0).alias("v"))
    x, y = geometry.project(H, F.col("u"), F.col("v"))
    return calibrate.loo_rms(calibrate.point_errors(p.withColumn("x", x + F.col("n") % 3 * 0.1).withColumn("y", y)))

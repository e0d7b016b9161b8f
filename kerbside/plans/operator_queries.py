"""Queries of sources, sinks, masks, calibration, alignment, maps and evaluation; what sources read is written first, from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import service, sinks
from ..functions import geodesy, geometry
from ..operators import align, calibrate, evaluation, lane_graph, masks, matching, motion_field, paint, pipelines, sequences, spatial_join, summaries, taxonomy
from ..operators.graph import shared_dir
from ..sources import calibration, datasets, replay, roads
from ..sources import cameras as directories
from . import tables
from .tables import BOXES, DRIVES, ROADS, read

#: Keys whose rows go to one written document.
STRETCH = 20_000
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _fresh(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{shared_dir(spark)}/kerbside-{uuid.uuid4().hex}"


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# sources and sinks


@query("SELECT event_type AS cctv_id, user_id::INT AS frame, event_id::INT AS id, event_type AS class, value AS confidence FROM events")
def replay_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("cctv_id"), F.col("user_id").alias("frame"), F.col("event_id").alias("id"), F.col("event_type").alias("class"), F.col("value").alias("confidence"), F.array(F.col("value"), F.lit(1.0)).alias("sat_coords"))
    path = _fresh(spark)
    sinks.write_replays(e, path, ["id", "class", "confidence", "sat_coords"])
    return replay.objects(replay.read(spark, path)).select("cctv_id", "frame", "id", "class", "confidence")


@query("SELECT event_type AS cctv_id, count(DISTINCT user_id)::BIGINT AS n_frames, count(*)::BIGINT AS n_objects FROM events GROUP BY 1")
def replay_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec by the files' first bytes."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("cctv_id"), F.col("user_id").alias("frame"), F.col("event_id").alias("id"))
    path = _fresh(spark)
    sinks.write_replays(e.repartition("cctv_id"), path, ["id"])
    f = replay.frames(replay.read_by_content(spark, f"{path}/*.json.gz"))
    return f.groupBy(F.col("location_code").alias("cctv_id")).agg(F.count(F.lit(1)).alias("n_frames"), F.sum("n_objects").alias("n_objects"))


_FILES = "SELECT 'c' || (o_custkey % 7) AS cctv_id, 'c' || (o_custkey % 7) || '/' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '_reprojected' ELSE '' END AS path, o_totalprice::BIGINT AS length, o_orderdate AS modified, o_orderkey % 2 = 0 AS published FROM orders"


@query(f"""WITH f AS ({_FILES}), r AS (SELECT *, row_number() OVER (PARTITION BY cctv_id ORDER BY modified DESC, path DESC) AS a, row_number() OVER (PARTITION BY cctv_id ORDER BY published DESC, path LIKE '%reprojected%' DESC, length DESC, path) AS c FROM f),
 o AS (SELECT cctv_id, path, row_number() OVER (PARTITION BY cctv_id ORDER BY length DESC, path DESC) AS b FROM f WHERE path NOT LIKE '%reprojected%')
 SELECT cctv_id, max(path) FILTER (WHERE a = 1) AS newest, max(path) FILTER (WHERE c = 1) AS chosen, (SELECT path FROM o WHERE o.cctv_id = r.cctv_id AND b = 1) AS largest FROM r GROUP BY 1""")
def replay_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    cam = F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string"))
    path = F.concat(cam, F.lit("/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "_reprojected").otherwise(""))
    f = o.select(cam.alias("cctv_id"), path.alias("path"), F.round("o_totalprice").cast("long").alias("length"), F.col("o_orderdate").alias("modified"), (F.col("o_orderkey") % 2 == 0).alias("published"))
    named = [replay.newest(f, ["cctv_id"]).withColumnRenamed("path", "newest"), replay.choose(f).select("cctv_id", F.col("path").alias("chosen")), replay.largest_original(f, ["cctv_id"]).withColumnRenamed("path", "largest")]
    return named[0].join(named[1], "cctv_id").join(named[2], "cctv_id")


@query("""SELECT 'N' || n_nationkey AS cctv_id, n_nationkey::DOUBLE AS h00, (n_regionkey + 0.5)::DOUBLE AS h12, CASE WHEN n_nationkey % 2 = 0 THEN 9.5::DOUBLE ELSE 0.0::DOUBLE END AS cam_z, CASE WHEN n_nationkey % 3 = 0 THEN 'in' ELSE 'partial' END AS roi_method, k::INT AS n, (n_nationkey + k * 10.0)::DOUBLE AS u, (127.0 + k)::DOUBLE AS lon
 FROM nation, (SELECT unnest([0, 1, 2]) AS k) WHERE k <= n_nationkey % 3""")
def calibration_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double").alias("k"), F.col("n_regionkey").cast("double").alias("r"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"))
    zero = F.lit(0.0)
    matrix = F.array(F.array("k", zero, zero), F.array(zero, zero, F.col("r") + 0.5), F.array(zero, zero, F.lit(1.0)))
    anchors = F.transform(F.sequence(F.lit(0), (F.col("k") % 3).cast("int")), lambda i: F.struct(F.array(F.col("k") + i * 10.0, zero).alias("px"), F.array(i + 127.0, zero).alias("lonlat")))
    docs = n.select(F.struct(F.col("name").alias("location_code")).alias("meta"), F.struct(matrix.alias("H"), anchors.alias("anchors_list")).alias("homography"), F.when(F.col("k") % 2 == 0, F.struct(F.lit(9.5).alias("z_cam_meters"))).alias("parallax"), F.when(F.col("k") % 3 == 0, "in").alias("roi_method"))
    path = _fresh(spark)
    docs.repartition("meta").write.option("maxRecordsPerFile", 1).json(path)
    c = calibration.read(spark, path)
    flat = calibration.flat(c).join(c.select(F.col("meta.location_code").alias("cctv_id"), "roi_method"), "cctv_id")
    return flat.join(calibration.anchors(c), "cctv_id").select("cctv_id", "h00", "h12", "cam_z", "roi_method", "n", "u", "lon")


@query("""SELECT l_orderkey, l_linenumber, (CASE l_returnflag WHEN 'A' THEN 1.8 WHEN 'N' THEN 2.5 END)::DOUBLE AS width, (CASE l_returnflag WHEN 'A' THEN 1.5 WHEN 'N' THEN 3.5 ELSE 1.55 END)::DOUBLE AS height, l_returnflag IN ('A', 'N') AS have_measurements FROM lineitem""")
def dimension_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark)
    spark.createDataFrame([('{"base": {" a ": {"width": 1.8, "length": 4.5, "height": 1.5}, "N": {"width": 2.5, "length": 12, "height": 3.5}}, "_comment": ["x"]}',)], "value string").coalesce(1).write.text(path)
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("class"))
    return calibration.with_dimensions(rows, calibration.priors(spark, path).where("set = 'base'"), 1.55).select("l_orderkey", "l_linenumber", "width", "height", "have_measurements")


@query("""SELECT s_name AS name, s_acctbal / 100.0::DOUBLE AS lon, s_nationkey * 1.0::DOUBLE AS lat, 'u' || s_suppkey AS url FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AND s_acctbal / 100.0 BETWEEN 10 AND 80 AND s_nationkey BETWEEN 3 AND 20""")
def camera_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved responses, with coordinates that are no numbers and rows without an address."""
    s = read(spark, sf_dir, "supplier")
    lon = F.when(F.col("s_suppkey") % 5 == 0, "here").otherwise((F.col("s_acctbal") / 100.0).cast("string"))
    one = F.struct(lon.alias("coordx"), F.col("s_nationkey").cast("string").alias("coordy"), F.col("s_name").alias("cctvname"), F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("u"), F.col("s_suppkey").cast("string"))).alias("cctvurl"))
    path = _fresh(spark)
    s.groupBy("s_nationkey").agg(F.struct(F.collect_list(one).alias("data")).alias("response")).select("response").write.option("maxRecordsPerFile", 1).json(path)
    return directories.read_response(spark, path, (10.0, 3.0, 80.0, 20.0), need_url=True).select("name", "lon", "lat", "url")


@query("SELECT c_custkey AS cam_id, c_name AS name, 'rtsp://' || o_orderkey AS stream FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 40) JOIN orders ON o_custkey = c_custkey")
def camera_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    cams = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cam_id"), F.col("c_name").alias("name"))
    streams = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cam_id"), F.concat(F.lit("rtsp://"), F.col("o_orderkey").cast("string")).alias("stream"))
    return directories.with_streams(cams, streams, "cam_id", 40).select("cam_id", "name", "stream")


_DIRECTORY = "SELECT 'k' || s_suppkey AS cctv_id, CASE WHEN s_suppkey % 4 <> 0 THEN 'n' || s_suppkey % 50 END AS name, 127.0 + s_acctbal / 1e6 AS lon, 37.0 + s_nationkey / 1e4 AS lat, s_suppkey % 3 = 0 AS has_replay FROM supplier"


def _directory(spark: SparkSession, sf_dir: str, prefix: str = "k") -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit(prefix), F.col("s_suppkey").cast("string")).alias("cctv_id"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("n"), (F.col("s_suppkey") % 50).cast("string"))).alias("name"), (F.col("s_acctbal") / 1e6 + 127.0).alias("lon"), (F.col("s_nationkey") / 1e4 + 37.0).alias("lat"), (F.col("s_suppkey") % 3 == 0).alias("has_replay"))


@query(f"""WITH d AS ({_DIRECTORY}) SELECT cctv_id, name, lon, lat, has_replay FROM d WHERE NOT (cctv_id = 'k7' OR coalesce(name = 'n7', false) OR (NOT has_replay AND sqrt(power((lon - 127.004) * {geodesy.METRES_LON}, 2) + power((lat - 37.001) * {geodesy.METRES_LAT}, 2)) < 250))
 UNION ALL SELECT 'k7', 'n7', 127.004, 37.001, true""")
def camera_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([("k7", "n7", 127.004, 37.001, True)], "cctv_id string, name string, lon double, lat double, has_replay boolean")
    return directories.upsert(_directory(spark, sf_dir), new)


@query(f"""WITH d AS ({_DIRECTORY}), k AS (SELECT * FROM d WHERE has_replay), f AS (SELECT 'x' || cctv_id AS cctv_id, name, lon + 0.002 AS lon, lat, false AS has_replay FROM d)
 SELECT cctv_id, name, lon, lat FROM k UNION ALL SELECT cctv_id, name, lon, lat FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.name = f.name)
 AND NOT EXISTS (SELECT 1 FROM k WHERE sqrt(power((k.lon - f.lon) * 88800.0, 2) + power((k.lat - f.lat) * 111000.0, 2)) < 250)""")
def camera_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _directory(spark, sf_dir)
    found = _directory(spark, sf_dir, "xk").withColumn("lon", F.col("lon") + 0.002).withColumn("has_replay", F.lit(False))
    return directories.refresh(d, found).select("cctv_id", "name", "lon", "lat")


@query("SELECT section, path FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY rank, path) AS r FROM (SELECT p_brand AS section, p_size AS rank, p_name AS path FROM part)) WHERE r = 1")
def section_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("section"), F.col("p_size").alias("rank"), F.col("p_name").alias("path"))
    return roads.prefer(p).select("section", "path")


@query("""WITH b AS (SELECT s_suppkey AS id, s_acctbal / 100.0 AS west, s_nationkey * 1.0 AS south, s_acctbal / 100.0 + 5 AS east, s_nationkey + 2.0 AS north FROM supplier), t AS (SELECT n_nationkey * 4.0 AS lon, n_nationkey % 6 * 3.0 AS lat FROM nation)
 SELECT id FROM b WHERE EXISTS (SELECT 1 FROM t WHERE lon BETWEEN west - 0.5 AND east + 0.5 AND lat BETWEEN south - 0.5 AND north + 0.5)""")
def bounds_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100.0).alias("west"), (F.col("s_nationkey") * 1.0).alias("south"), (F.col("s_acctbal") / 100.0 + 5).alias("east"), (F.col("s_nationkey") + 2.0).alias("north"))
    t = read(spark, sf_dir, "nation").select((F.col("n_nationkey") * 4.0).alias("lon"), (F.col("n_nationkey") % 6 * 3.0).alias("lat"))
    return roads.overlapping(b, t, 0.5).select("id")


@query(f"""WITH b AS (SELECT 'f' || l_orderkey % 500 AS image, cctv_id AS class, x1, y1, x2, y2, l_orderkey % 500 AS n FROM ({BOXES})), k AS (SELECT image, row_number() OVER (ORDER BY image) - 1 AS r FROM (SELECT DISTINCT image FROM b)) SELECT b.image, class, x1, y1, x2, y2 FROM b JOIN k USING (image) WHERE r % 3 = 0""")
def csv_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    path = _fresh(spark)
    b.select(F.concat(F.lit("f"), (F.col("l_orderkey") % 500).cast("string")).alias("image"), F.col("cctv_id").alias("class"), "x1", "y1", "x2", "y2").write.option("header", True).csv(path)
    return datasets.read_csv_boxes(spark, path, 3)


@query(f"SELECT 'L' || cctv_id AS loc, l_orderkey::INT AS frame, l_linenumber::INT AS track_id, 'car' AS class, x1, y1, x2, y2 FROM ({BOXES})")
def label_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each camera and stretch of frames, so that none grows with the table."""
    b = tables.boxes(spark, sf_dir)
    box = F.struct(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("track_id"), F.lit("car").alias("class"), F.array("x1", "y1", "x2", "y2").alias("bbox"))
    frame = F.struct(F.col("l_orderkey").alias("index"))
    docs = b.groupBy(F.concat(F.lit("L"), "cctv_id").alias("loc"), F.floor(F.col("l_orderkey") / STRETCH).alias("stretch")).agg(F.collect_list(box).alias("boxes"), F.collect_set(frame).alias("frames"))
    path = _fresh(spark)
    docs.drop("stretch").write.option("maxRecordsPerFile", 1).json(path)
    return datasets.read_labels(spark, path)[0]


@query(f"""WITH b AS (SELECT l_orderkey % 40 AS num, l_linenumber::INT AS id, cctv_id AS class, x1, y1, x2, y2 FROM ({BOXES}) WHERE l_orderkey % 40 > 0) SELECT num::INT AS frame, id AS track_id, class, x1, y1, x2, y2 FROM b WHERE (num - 1) % 4 = 0""")
def xml_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of frames in XML, one for each stretch of orders; every fourth frame is read."""
    b = tables.boxes(spark, sf_dir).withColumns({"num": F.col("l_orderkey") % 40, "stretch": F.floor(F.col("l_orderkey") / STRETCH)}).where("num > 0")
    target = F.format_string('<target id="%d"><box left="%s" top="%s" width="%s" height="%s"/><attribute vehicle_type="%s"/></target>', F.col("l_linenumber").cast("int"), F.col("x1").cast("string"), F.col("y1").cast("string"), (F.col("x2") - F.col("x1")).cast("string"), (F.col("y2") - F.col("y1")).cast("string"), F.col("cctv_id"))
    frames = b.groupBy("stretch", "num").agg(F.array_join(F.collect_list(target), "").alias("t")).select("stretch", F.format_string('<frame num="%d"><target_list>%s</target_list></frame>', F.col("num").cast("int"), F.col("t")).alias("value"))
    path = _fresh(spark)
    files = frames.groupBy("stretch").agg(F.concat(F.lit("<sequence>"), F.array_join(F.collect_list("value"), ""), F.lit("</sequence>")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return datasets.read_xml_frames(spark, f"{path}/*.txt", 4)[0].select("frame", "track_id", "class", "x1", "y1", "x2", "y2")


@query("SELECT 16 AS z, n_nationkey::INT AS x, n_regionkey::INT AS y, CASE WHEN n_nationkey % 5 <> 0 THEN '16/' || n_nationkey || '/' || n_regionkey END AS content FROM nation")
def tile_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles by the caller's own way to the bytes, which fails for some."""

    def get(z: int, x: int, y: int) -> bytes:
        if x % 5 == 0:
            raise OSError("no such tile")
        return f"{z}/{x}/{y}".encode()

    t = read(spark, sf_dir, "nation").select(F.lit(16).alias("z"), F.col("n_nationkey").alias("x"), F.col("n_regionkey").alias("y"))
    return pipelines.fetch_tiles(t, get).withColumn("content", F.col("content").cast("string"))


@query("""SELECT event_type AS cctv_id, event_id, value FROM events WHERE event_type NOT IN ('click', 'error') OR (event_type = 'click' AND event_id % 2 = 0)""")
def camera_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose cameras click and error are loaded anew, twice: of click half the rows come, of error none."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("cctv_id"), "event_id", "value")
    path = _fresh(spark)
    e.write.partitionBy("cctv_id").parquet(path)
    for _ in range(2):
        sinks.replace_cameras(e.where("cctv_id = 'click' and event_id % 2 = 0"), path, ["click", "error"])
    return spark.read.parquet(path).select("cctv_id", "event_id", "value")


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS note FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def table_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark)
    keep = ["n_nationkey", "n_name", "note"]
    sinks.append(read(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("long")), path, keep)
    sinks.append(read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("n_nationkey"), F.col("r_name").alias("note")), path, keep)
    return spark.read.parquet(path)


@query("SELECT o_custkey AS key, max(o_orderkey) AS last FROM orders GROUP BY 1")
def table_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders merged in by customer in two loads, the newest staying."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("last"))
    path = _fresh(spark)
    for part in (1, 0):
        sinks.upsert(spark, o.where(F.col("last") % 2 == part), path, ["key"], "last")
    return spark.read.parquet(path)


@query("SELECT CASE event_type WHEN 'click' THEN 'tap' WHEN 'error' THEN 'fault' ELSE event_type END AS cctv_id, count(*)::BIGINT AS n FROM events GROUP BY 1")
def table_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark)
    read(spark, sf_dir, "events").select(F.col("event_type").alias("cctv_id"), "event_id").write.parquet(path)
    sinks.rename_tables(spark, [path], {"click": "tap", "error": "fault"})
    return spark.read.parquet(path).groupBy("cctv_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def report_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark)
    sinks.write_json(read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("n_regionkey long, n long").json(path)


@query("SELECT r_name AS class, r_regionkey::INT AS number, true AS refused FROM region")
def taxonomy_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of classes noted beside a data set; another list is refused."""
    names = [r.r_name for r in read(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    path = _fresh(spark)
    sinks.guard(spark, path, names)
    sinks.guard(spark, path, names)
    try:
        sinks.guard(spark, path, names[1:])
        refused = False
    except ValueError:
        refused = True
    noted = spark.read.text(f"{path}/_classes")
    return noted.select(F.expr("substring(value, 8)").alias("class"), F.substring("value", 1, 6).cast("int").alias("number"), F.lit(refused).alias("refused"))


# masks and filters


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask: for each nation a block of 3 x (1 + key % 4) pixels, apart from the others."""
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("cctv_id"), F.col("n_nationkey").cast("int").alias("k"))
    return n.withColumn("x", F.explode(F.sequence(F.col("k") * 5, F.col("k") * 5 + 2))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") % 4)))


_MASK = "SELECT 'r' || n_regionkey AS cctv_id, n_nationkey AS k, n_nationkey * 5 + dx AS x, dy AS y FROM nation, (SELECT unnest([0, 1, 2]) AS dx), (SELECT unnest([0, 1, 2, 3]) AS dy) WHERE dy <= n_nationkey % 4"


@query(f"""WITH m AS ({_MASK}), g AS (SELECT cctv_id, k, count(*)::BIGINT AS area, min(x)::INT AS x1, min(y)::INT AS y1, max(x)::INT AS x2, max(y)::INT AS y2 FROM m GROUP BY 1, 2)
 SELECT cctv_id, (row_number() OVER (PARTITION BY cctv_id ORDER BY area DESC, y1, x1) - 1)::INT AS region, area, x1, y1, x2, y2 FROM g WHERE area >= 6""")
def mask_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.regions(_blocks(spark, sf_dir), 6)


_MASKED = f"m AS ({_MASK}), b AS (SELECT s_suppkey AS box_id, 'r' || s_suppkey % 5 AS cctv_id, (s_suppkey * 7 % 115)::INT AS x1, (s_suppkey % 3)::INT AS y1, (s_suppkey * 7 % 115 + 4 + s_suppkey % 3)::INT AS x2, (s_suppkey % 3 + 2)::INT AS y2 FROM supplier)"


def _mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 7 % 115).cast("int"), (k % 3).cast("int")
    return read(spark, sf_dir, "supplier").select(k.alias("box_id"), F.concat(F.lit("r"), (k % 5).cast("string")).alias("cctv_id"), x.alias("x1"), y.alias("y1"), (x + 4 + (k % 3).cast("int")).alias("x2"), (y + 2).alias("y2"))


@query(f"""WITH {_MASKED} SELECT box_id, (SELECT count(*) FROM m WHERE m.cctv_id = b.cctv_id AND x >= x1 AND x < x2 AND y >= y1 AND y < y2)::BIGINT AS masked, round((SELECT count(*) FROM m WHERE m.cctv_id = b.cctv_id AND x >= x1 AND x < x2 AND y >= y1 AND y < y2) / ((x2 - x1) * (y2 - y1)), 6) AS share FROM b""")
def mask_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(masks.coverage(_mask_boxes(spark, sf_dir), masks.summed_area(_blocks(spark, sf_dir))), "share").withColumn("masked", F.col("masked").cast("long"))


@query(f"""WITH {_MASKED} SELECT box_id, EXISTS (SELECT 1 FROM m WHERE m.cctv_id = b.cctv_id AND x = x1 AND y = y1) AND EXISTS (SELECT 1 FROM m WHERE m.cctv_id = b.cctv_id AND x = x2 AND y = y1) AND EXISTS (SELECT 1 FROM m WHERE m.cctv_id = b.cctv_id AND x = x1 AND y = y2) AND EXISTS (SELECT 1 FROM m WHERE m.cctv_id = b.cctv_id AND x = x2 AND y = y2) AS whole
 FROM (SELECT box_id, cctv_id, x1, y1, x1 + 1 AS x2, y1 + 1 AS y2 FROM b) b WHERE EXISTS (SELECT 1 FROM m WHERE m.cctv_id = b.cctv_id AND x >= x1 AND x < x2 AND y >= y1 AND y < y2)""")
def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one pixel step in a region by any pixel; whether all their corners are."""
    b = _mask_boxes(spark, sf_dir).withColumns({"x2": F.col("x1") + 1, "y2": F.col("y1") + 1})
    area = masks.summed_area(_blocks(spark, sf_dir))
    some, whole = masks.inside(b, area), masks.inside(b, area, "in").withColumn("whole", F.lit(True))
    return some.join(whole, "box_id", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))


@query(f"WITH b AS ({BOXES}) SELECT l_orderkey, l_linenumber FROM b WHERE greatest(0, least(x2, 400) - greatest(x1, 200)) * greatest(0, least(y2, 500) - greatest(y1, 100)) / ((x2 - x1) * (y2 - y1)) < 0.6")
def covered_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    return masks.drop_covered(b, masks.covered_by(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), [(200, 100, 400, 500)])).select("l_orderkey", "l_linenumber")


@query(f"""WITH b AS ({BOXES}), r AS (SELECT r_name[1:1] AS cctv_id, r_regionkey * 150.0 AS x1, 0.0 AS y1, r_regionkey * 150.0 + 100 AS x2, 400.0 AS y2 FROM region)
 SELECT l_orderkey, l_linenumber FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.cctv_id = b.cctv_id AND (b.x1 + b.x2) / 2 BETWEEN r.x1 AND r.x2 AND (b.y1 + b.y2) / 2 BETWEEN r.y1 AND r.y2)""")
def ignore_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region").select(F.substring("r_name", 1, 1).alias("cctv_id"), (F.col("r_regionkey") * 150.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("r_regionkey") * 150.0 + 100).alias("x2"), F.lit(400.0).alias("y2"))
    return datasets.outside(tables.boxes(spark, sf_dir), r, "cctv_id").select("l_orderkey", "l_linenumber")


@query(f"""WITH b AS (SELECT DISTINCT cctv_id, unnest(generate_series(floor(x1 / 100)::INT, greatest(floor(x1 / 100), ceil(x2 / 100) - 1)::INT)) AS x, y1, y2 FROM ({BOXES})), c AS (SELECT DISTINCT cctv_id, x, unnest(generate_series(floor(y1 / 100)::INT, greatest(floor(y1 / 100), ceil(y2 / 100) - 1)::INT)) AS y FROM b)
 SELECT DISTINCT cctv_id, (x + dx)::INT AS x, (y + dy)::INT AS y FROM c, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)""")
def road_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.road_cells(tables.boxes(spark, sf_dir), 100)


@query("""WITH p AS (SELECT event_type AS g, value AS x, value * 0.3 + event_id % 17 AS y FROM events), c AS (SELECT g, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM p GROUP BY 1),
 e AS (SELECT g, sqrt(((xx + yy) / 2 + sqrt(power(xx - yy, 2) / 4 + xy * xy)) / greatest(1e-9, (xx + yy) / 2 - sqrt(power(xx - yy, 2) / 4 + xy * xy))) AS r FROM c) SELECT g, round(r, 6) AS elongation FROM e WHERE r >= 1.6""")
def elongated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "events").select(F.col("event_type").alias("g"), F.col("value").alias("x"), (F.col("value") * 0.3 + F.col("event_id") % 17).alias("y"))
    return _rounded(masks.elongated(p, ["g"]), "elongation")


@query(f"""WITH b AS ({BOXES}), m AS (SELECT * FROM (VALUES ('A', 'car'), ('N', 'bus'), ('R', '__drop__')) t(c, target)), i AS (SELECT DISTINCT l_orderkey AS image FROM lineitem),
 j AS (SELECT l_orderkey AS image, target <> '__drop__' AS known, least(400, x2) - least(400, x1) >= 3 AND least(300, y2) - least(300, y1) >= 3 AS good FROM b LEFT JOIN m ON c = cctv_id), p AS (SELECT image, count(*) FILTER (WHERE known AND good) AS kept, count(*) FILTER (WHERE NOT known) AS dropped, count(*) FILTER (WHERE known AND NOT good) AS bad FROM j GROUP BY 1)
 SELECT count(*)::BIGINT AS images, sum(kept)::BIGINT AS kept, sum(dropped)::BIGINT AS dropped, sum(bad)::BIGINT AS bad, count(*) FILTER (WHERE kept = 0)::BIGINT AS empty FROM i LEFT JOIN p USING (image)""")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir).select(F.col("l_orderkey").alias("image"), F.col("cctv_id").alias("class"), "x1", "y1", "x2", "y2")
    images = b.select("image").distinct().withColumns({"width": F.lit(400), "height": F.lit(300)})
    mapping = spark.createDataFrame([("A", "car"), ("N", "bus"), ("R", taxonomy.DROP)], "class string, target string")
    return taxonomy.build_counts(images, b, mapping)


# geometry, calibration, alignment

_K, _D = [800.0, 0.0, 500.0, 0.0, 820.0, 350.0, 0.0, 0.0, 1.0], [-0.2, 0.05, 0.001, -0.002, 0.01]
_LENS = f"""SELECT l_orderkey, l_linenumber, x1, y1, x, y, x * x + y * y AS r FROM (SELECT *, (x1 - 500.0) / 800.0 AS x, (y1 - 350.0) / 820.0 AS y FROM ({BOXES}))"""
_RADIAL = "(1.0 + r * (-0.2 + r * (0.05 + r * 0.01)))"


@query(f"""WITH l AS ({_LENS}) SELECT l_orderkey, l_linenumber, round((x * {_RADIAL} + 2.0 * 0.001 * x * y - 0.002 * (r + 2.0 * x * x)) * 800.0 + 500.0, 4) AS u, round((y * {_RADIAL} + 0.001 * (r + 2.0 * y * y) - 2.0 * 0.002 * x * y) * 820.0 + 350.0, 4) AS v FROM l""")
def lens_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = geometry.distort(_K, _D, F.col("x1"), F.col("y1"))
    return _rounded(tables.boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", u.alias("u"), v.alias("v")), "u", "v", digits=4)


@query(f"SELECT l_orderkey, l_linenumber, round(x1, 2) AS u, round(y1, 2) AS v FROM ({BOXES})")
def lens_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel distorted and undistorted again."""
    b = tables.boxes(spark, sf_dir)
    du, dv = geometry.distort(_K, _D, F.col("x1"), F.col("y1"))
    u, v = geometry.undistort(_K, _D, F.col("du"), F.col("dv"), rounds=30)
    return _rounded(b.withColumns({"du": du, "dv": dv}).select("l_orderkey", "l_linenumber", u.alias("u"), v.alias("v")), "u", "v", digits=2)


@query(f"""SELECT s_suppkey, 300000.0 + s_acctbal / 10.0::DOUBLE AS easting, 4100000.0 + s_nationkey * 3.0::DOUBLE AS northing, round(sqrt(power(s_acctbal / 1e5 * {geodesy.METRES_DEGREE} * cos(radians(37.0 + s_nationkey / 100.0)), 2) + power(0.01 * {geodesy.METRES_DEGREE}, 2)), 4) AS metres FROM supplier""")
def local_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = geodesy.local_to_utm(F.col("s_acctbal") / 10.0, F.col("s_nationkey") * 3.0, F.lit(300000.0), F.lit(4100000.0))
    lat = F.col("s_nationkey") / 100.0 + 37.0
    metres = geodesy.cosine_distance(F.lit(127.0), lat, F.col("s_acctbal") / 1e5 + 127.0, lat + 0.01)
    return read(spark, sf_dir, "supplier").select("s_suppkey", e.alias("easting"), n.alias("northing"), F.round(metres, 4).alias("metres"))


@query("""WITH p AS (SELECT event_type AS g, value AS u, (event_id % 50)::DOUBLE AS v, 3.0 * value + event_id % 7 AS x FROM events) SELECT g AS cctv_id, count(*)::DOUBLE AS n, round(sum(u), 4) AS u, round(sum(u * v), 3) AS uv, round(sum(u * x), 2) AS ux, round(sum(v * x), 3) AS vx FROM p GROUP BY 1""")
def affine_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "events").select(F.col("event_type").alias("cctv_id"), F.col("value").alias("u"), (F.col("event_id") % 50 * 1.0).alias("v"), (F.col("value") * 3.0 + F.col("event_id") % 7).alias("x"), F.lit(0.0).alias("y"))
    s = calibrate.affine_sums(p)
    return s.select("cctv_id", "n", F.round("u", 4).alias("u"), F.round("uv", 3).alias("uv"), F.round("ux", 2).alias("ux"), F.round("vx", 3).alias("vx"))


@query("SELECT 'N' || n_regionkey AS cctv_id, 2.0::DOUBLE AS a, 0.5::DOUBLE AS b, 10.0::DOUBLE AS c, -1.0::DOUBLE AS d, 3.0::DOUBLE AS e, -20.0::DOUBLE AS f FROM nation GROUP BY 1")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affine map that made the points, found again from their sums."""
    p = read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_regionkey").cast("string")).alias("cctv_id"), F.col("n_nationkey").cast("double").alias("u"), (F.col("n_nationkey") * F.col("n_nationkey") % 11).cast("double").alias("v"))
    p = p.withColumns({"x": 2.0 * F.col("u") + 0.5 * F.col("v") + 10.0, "y": 3.0 * F.col("v") - F.col("u") - 20.0})
    rows = [(r.cctv_id, *(round(float(x), 6) for x in calibrate.solve_affine(r).ravel())) for r in calibrate.affine_sums(p).collect()]  # one row for each camera
    return spark.createDataFrame(rows, "cctv_id string, a double, b double, c double, d double, e double, f double")


_TURNED = "s_acctbal / 10.0 - 5.0 AS u, s_nationkey - 2.0 AS v"


@query(f"""WITH s AS (SELECT s_suppkey, {_TURNED} FROM supplier) SELECT s_suppkey, round(5.0 + 1.5 * (cos(radians(30)) * u - sin(radians(30)) * v) + 7.0, 6) AS x, round(2.0 + 1.5 * (sin(radians(30)) * u + cos(radians(30)) * v) - 3.0, 6) AS y FROM s""")
def similarity_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = align.apply_similarity(F.col("s_acctbal") / 10.0, F.col("s_nationkey") * 1.0, (5.0, 2.0), 7.0, -3.0, 30.0, 1.5)
    return _rounded(read(spark, sf_dir, "supplier").select("s_suppkey", x.alias("x"), y.alias("y")), "x", "y")


_PLACES = "SELECT c_nationkey AS cam, c_acctbal / 100.0 AS u, (c_custkey * 7 % 101)::DOUBLE AS v, c_custkey % 7 - 3 AS e FROM customer"


@query(f"""WITH p AS (SELECT cam, u, v, 1.5 * (cos(radians(cam)) * u - sin(radians(cam)) * v) + 7.0 + e * 0.1::DOUBLE AS x, 1.5 * (sin(radians(cam)) * u + cos(radians(cam)) * v) - 3.0 - e * 0.2::DOUBLE AS y FROM ({_PLACES})),
 m AS (SELECT cam, avg(u) AS mu, avg(v) AS mv, avg(x) AS mx, avg(y) AS my FROM p GROUP BY 1), c AS (SELECT cam, u - mu AS u, v - mv AS v, x - mx AS x, y - my AS y FROM p JOIN m USING (cam)),
 s AS (SELECT cam, sum(u * x + v * y) / sum(u * u + v * v) AS a, sum(u * y - v * x) / sum(u * u + v * v) AS d FROM c GROUP BY 1)
 SELECT cam, round(a, 6) AS a, round(d, 6) AS d, round(mx - a * mu + d * mv, 6) AS c, round(my - d * mu - a * mv, 6) AS f FROM s JOIN m USING (cam)""")
def similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn, scale and shift between the noisy points of each of 25 cameras."""
    e, cam = F.col("c_custkey") % 7 - 3, F.radians("cam")
    p = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cam"), (F.col("c_acctbal") / 100.0).alias("u"), (F.col("c_custkey") * 7 % 101).cast("double").alias("v"), e.alias("e"))
    x = 1.5 * (F.cos(cam) * F.col("u") - F.sin(cam) * F.col("v")) + 7.0 + F.col("e") * 0.1
    y = 1.5 * (F.sin(cam) * F.col("u") + F.cos(cam) * F.col("v")) - 3.0 - F.col("e") * 0.2
    return _rounded(calibrate.similarity_fits(p.withColumns({"x": x, "y": y}), "cam").select("cam", "a", "d", "c", "f"), "a", "d", "c", "f")


_SEGMENTS = "SELECT s_suppkey AS seg_id, s_nationkey * 2.0 AS ax, s_acctbal / 200.0 AS ay, s_nationkey * 2.0 + 3.0 + s_suppkey % 4 AS bx, s_acctbal / 200.0 + s_suppkey % 9 - 4.0 AS b_y FROM supplier"


@query(f"""WITH s AS ({_SEGMENTS}), p AS (SELECT a.seg_id AS a, b.seg_id AS b, a.ax AS px, a.ay AS py, a.bx - a.ax AS ux, a.b_y - a.ay AS uy, b.ax AS qx, b.ay AS qy, b.bx - b.ax AS vx, b.b_y - b.ay AS vy FROM s a JOIN s b ON a.seg_id < b.seg_id AND sqrt(power((a.ax + a.bx - b.ax - b.bx) / 2, 2) + power((a.ay + a.b_y - b.ay - b.b_y) / 2, 2)) <= 12),
 t AS (SELECT *, ux * vy - uy * vx AS det FROM p), c AS (SELECT *, ((qx - px) * vy - (qy - py) * vx) / det AS t, ((qx - px) * uy - (qy - py) * ux) / det AS s, abs(det) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)) AS sine FROM t WHERE det <> 0)
 SELECT a, b, round(px + t * ux, 6) AS x, round(py + t * uy, 6) AS y FROM c WHERE t BETWEEN 0.02 AND 0.98 AND s BETWEEN 0.02 AND 0.98 AND degrees(asin(least(1.0, sine))) >= 30""")
def segment_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    seg = s.select(F.col("s_suppkey").alias("seg_id"), (F.col("s_nationkey") * 2.0).alias("ax"), (F.col("s_acctbal") / 200.0).alias("ay"), (F.col("s_nationkey") * 2.0 + 3.0 + F.col("s_suppkey") % 4).alias("bx"), (F.col("s_acctbal") / 200.0 + F.col("s_suppkey") % 9 - 4.0).alias("by"))
    return _rounded(calibrate.crossings(seg), "x", "y")


@query("""WITH p AS (SELECT s_suppkey AS poly_id, list_value({'x': 0.0, 'y': 0.0}, {'x': 10.0 + s_nationkey, 'y': s_suppkey % 5 * 1.0}, {'x': 8.0, 'y': 9.0}, {'x': s_suppkey % 3 * 0.2, 'y': 6.0}) AS pts FROM supplier), e AS (SELECT poly_id, n, pts[n + 1] AS p, pts[(n + 3) % 4 + 1] AS a, pts[(n + 1) % 4 + 1] AS b FROM p, (SELECT unnest([0, 1, 2, 3]) AS n)),
 v AS (SELECT poly_id, n, p.x AS x, p.y AS y, a.x - p.x AS ax, a.y - p.y AS ay, b.x - p.x AS bx, b.y - p.y AS b_y FROM e), c AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (ax * bx + ay * b_y) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + b_y * b_y)))))) AS angle FROM v)
 SELECT poly_id, n::INT AS n, x::DOUBLE AS x, y::DOUBLE AS y, round(angle, 6) AS angle FROM c WHERE angle < 100 AND sqrt(ax * ax + ay * ay) >= 0.3 AND sqrt(bx * bx + b_y * b_y) >= 0.3""")
def polygon_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    pts = F.array(*(F.struct((F.lit(x) if isinstance(x, float) else x).cast("double").alias("x"), (F.lit(y) if isinstance(y, float) else y).cast("double").alias("y")) for x, y in ((0.0, 0.0), (F.col("s_nationkey") + 10.0, k % 5 * 1.0), (8.0, 9.0), (k % 3 * 0.2, 6.0))))
    return _rounded(calibrate.corners(read(spark, sf_dir, "supplier").select(k.alias("poly_id"), pts.alias("pts")), sharper=100.0), "angle")


@query(f"WITH l AS ({ROADS}) SELECT link_id, i::INT AS i, round(ax + i / 34.0 * (bx - ax), 6) AS x, round(ay + i / 34.0 * (b_y - ay), 6) AS y FROM l, (SELECT unnest(range(35)) AS i)")
def roads_densified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(align.densify(tables.roads(spark, sf_dir), 3.0).select("link_id", "i", "x", "y"), "x", "y")


@query(f"""WITH l AS ({ROADS}) SELECT link_id, a_node % 2 = 1 AS flipped, (CASE WHEN a_node % 2 = 1 THEN bx ELSE ax END)::DOUBLE AS x0 FROM l""")
def roads_flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose first node lies at their other end are turned; every second node is said to lie there."""
    links = tables.roads(spark, sf_dir).withColumn("from_node", F.concat("link_id", F.lit("@")))
    ends = F.when(F.expr("int(substring(link_id, 2)) % 2 = 1"), F.element_at("pts", -1)).otherwise(F.col("pts")[0])
    nodes = links.select(F.col("from_node").alias("node_id"), ends.alias("p")).select("node_id", "p.x", "p.y")
    return lane_graph.flip_by_node(links, nodes).select("link_id", "flipped", F.col("pts")[0]["x"].alias("x0"))


_FIELD = "SELECT (p_partkey % 40)::INT AS x, (p_partkey // 40)::INT AS y, p_size * 1.0 AS value FROM part WHERE p_partkey < 1600"


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").where("p_partkey < 1600")
    return p.select((F.col("p_partkey") % 40).cast("int").alias("x"), F.floor(F.col("p_partkey") / 40).cast("int").alias("y"), (F.col("p_size") * 1.0).alias("value"))


@query(f"""WITH f AS ({_FIELD}), p AS (SELECT s_suppkey AS id, s_acctbal / 250.0 AS x, s_nationkey * 1.7 AS y FROM supplier), c AS (SELECT p.*, i, j, CASE WHEN i = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE WHEN j = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END AS w FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
 h AS (SELECT c.id, c.w, f.value FROM c LEFT JOIN f ON f.x = floor(c.x) + i AND f.y = floor(c.y) + j) SELECT id, round(CASE WHEN count(*) FILTER (WHERE value IS NULL AND w > 0) = 0 THEN sum(w * value) ELSE 99.0 END, 6) AS value FROM h GROUP BY 1""")
def field_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 250.0).alias("x"), (F.col("s_nationkey") * 1.7).alias("y"))
    return _rounded(align.bilinear(p, _field(spark, sf_dir), 99.0).select("id", "value"), "value")


@query("""WITH a AS (SELECT s_suppkey AS id, s_acctbal / 100.0 AS x, s_nationkey * 1.0 AS y FROM supplier), b AS (SELECT n_nationkey AS id, n_nationkey * 4.0 AS x, n_regionkey * 5.0 AS y FROM nation),
 ab AS (SELECT avg(least(6.0, d)) AS d FROM (SELECT min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS d FROM a, b GROUP BY a.id)), ba AS (SELECT avg(least(6.0, d)) AS d FROM (SELECT min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS d FROM a, b GROUP BY b.id)) SELECT round((ab.d + ba.d) / 2, 6) AS chamfer FROM ab, ba""")
def chamfer_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100.0).alias("x"), (F.col("s_nationkey") * 1.0).alias("y"))
    b = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 4.0).alias("x"), (F.col("n_regionkey") * 5.0).alias("y"))
    return _rounded(align.chamfer(a, b, 6.0, both_ways=True), "chamfer")


@query("""WITH c AS (SELECT (s_suppkey % 10) * 1.0 AS dx, (s_suppkey // 10) % 10 * 1.0 AS dy, abs(s_acctbal) AS cost FROM supplier), m AS (SELECT min(cost) AS lo, median(cost) AS mi FROM c), l AS (SELECT dx, dy FROM c, m WHERE cost <= lo + 0.3 * (mi - lo)), v AS (SELECT count(*)::BIGINT AS n, var_samp(dx) AS xx, var_samp(dy) AS yy, covar_samp(dx, dy) AS xy FROM l)
 SELECT n, round(CASE WHEN n >= 6 THEN sqrt((xx + yy) / 2 + sqrt(power(xx - yy, 2) / 4 + xy * xy)) END, 6) AS major, round(CASE WHEN n >= 6 THEN sqrt(greatest(0, (xx + yy) / 2 - sqrt(power(xx - yy, 2) / 4 + xy * xy))) END, 6) AS minor FROM v""")
def valley_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = read(spark, sf_dir, "supplier").select((k % 10 * 1.0).alias("dx"), (F.floor(k / 10) % 10 * 1.0).alias("dy"), F.abs("s_acctbal").alias("cost"))
    return _rounded(align.anisotropy(c, 0.3), "major", "minor")


@query(f"""WITH f AS ({_FIELD}), p AS (SELECT c_custkey AS id, (c_custkey * 13 % 40)::DOUBLE AS x, (c_custkey * 7 % 40)::DOUBLE AS y FROM customer), s AS (SELECT a::DOUBLE AS dx, b::DOUBLE AS dy FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS a), (SELECT unnest([-2, -1, 0, 1, 2]) AS b)), t AS (SELECT *, floor(x / 20)::INT AS ti, floor(y / 20)::INT AS tj FROM p),
 c AS (SELECT ti, tj, dx, dy, count(*)::BIGINT AS n, avg(least(30.0, coalesce(value, 30.0))) AS cost FROM t CROSS JOIN s LEFT JOIN f ON f.x = floor(t.x + dx) AND f.y = floor(t.y + dy) GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY ti, tj ORDER BY cost, dx, dy) AS r, median(cost) OVER (PARTITION BY ti, tj) AS mi FROM c)
 SELECT ti, tj, n, dx, dy, round((mi - cost) / mi, 6) AS contrast FROM r WHERE r = 1 AND n >= 20""")
def local_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = read(spark, sf_dir, "customer").select(k.alias("id"), (k * 13 % 40).cast("double").alias("x"), (k * 7 % 40).cast("double").alias("y"))
    return _rounded(align.local_shifts(p, _field(spark, sf_dir), align.grid(spark, 2.0, 1.0), 1.0, 30.0, 20.0, 20, least_contrast=-1.0), "contrast")


@query("SELECT s_suppkey AS id, round_even(s_acctbal / 3.0::DOUBLE, 7) AS x, round_even(s_nationkey / 7.0::DOUBLE, 7) AS y, 2::INT AS n FROM supplier")
def rounded_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.array(F.col("s_acctbal") / 3.0, F.col("s_nationkey") / 7.0, F.lit(5.0))).alias("coordinates"))
    p = F.col("coordinates")[0]
    return pipelines.round_coordinates(s).select("id", p[0].alias("x"), p[1].alias("y"), F.size(p).alias("n"))


# events as images of 40 x 25 pixels with two bright lines on a noisy ground
_PIXELS = "SELECT event_id // 1000 AS image, (event_id % 40)::INT AS x, (event_id // 40 % 25)::INT AS y, (floor(value * 7)::BIGINT % 90 + CASE WHEN event_id % 40 IN (11, 12) OR event_id // 40 % 25 IN (17, 18) THEN 100 + event_id // 1000 % 50 ELSE 0 END)::INT AS gray, event_id % 40 > 2 AS inside FROM events"
_PAINT = f"""v AS MATERIALIZED ({_PIXELS}), k AS (SELECT unnest(range(-3, 4)) AS dy), disc AS MATERIALIZED (SELECT dy, dx FROM k, (SELECT unnest(range(-3, 4)) AS dx) WHERE abs(dx) <= round(sqrt(9 - dy * dy))),
 er AS MATERIALIZED (SELECT v.image, v.x, v.y, min(n.gray) AS g FROM v JOIN disc ON true JOIN v n ON n.image = v.image AND n.x = v.x + dx AND n.y = v.y + dy GROUP BY 1, 2, 3), op AS MATERIALIZED (SELECT er.image, er.x, er.y, max(n.g) AS g FROM er JOIN disc ON true JOIN er n ON n.image = er.image AND n.x = er.x + dx AND n.y = er.y + dy GROUP BY 1, 2, 3),
 th AS (SELECT v.*, (v.gray - op.g)::DOUBLE AS top_hat, inside AND gray > 0 AS ok FROM v JOIN op USING (image, x, y)), dk AS (SELECT image, quantile_cont(gray, 0.4) AS dark FROM th WHERE ok GROUP BY 1), sel AS (SELECT th.*, ok AND gray >= dark AS chosen FROM th JOIN dk USING (image)),
 lv AS (SELECT image, greatest(quantile_cont(top_hat, 0.92), 6) AS level FROM sel WHERE chosen GROUP BY 1), m AS MATERIALIZED (SELECT image, x, y, top_hat, chosen AND top_hat >= level AS p FROM sel JOIN lv USING (image)),
 full_ AS (SELECT a.image, a.x, a.y FROM m a JOIN m b ON b.image = a.image AND b.x = a.x + 1 AND b.y = a.y JOIN m c ON c.image = a.image AND c.x = a.x AND c.y = a.y + 1 JOIN m d ON d.image = a.image AND d.x = a.x + 1 AND d.y = a.y + 1 WHERE a.p AND b.p AND c.p AND d.p),
 q AS MATERIALIZED (SELECT m.image, m.x, m.y, top_hat, EXISTS (SELECT 1 FROM full_ f WHERE f.image = m.image AND f.x IN (m.x, m.x - 1) AND f.y IN (m.y, m.y - 1)) AS paint FROM m)"""


def _painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    x, y = (k % 40).cast("int"), (F.floor(k / 40) % 25).cast("int")
    line = F.when(x.isin(11, 12) | y.isin(17, 18), 100 + F.floor(k / 1000) % 50).otherwise(0)
    e = read(spark, sf_dir, "events").select(F.floor(k / 1000).alias("image"), x.alias("x"), y.alias("y"), (F.floor(F.col("value") * 7) % 90 + line).cast("int").alias("gray"), (x > 2).alias("inside"))
    return paint.paint_mask(e, radius=3)


@query(f"WITH {_PAINT} SELECT image, x, y, top_hat, paint FROM q")
def paint_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin bright structures of every image."""
    return _painted(spark, sf_dir)


@query(f"WITH {_PAINT} SELECT q.image, q.x, q.y, round(min(sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2))), 6) AS distance FROM q LEFT JOIN q p ON p.image = q.image AND p.paint GROUP BY 1, 2, 3")
def paint_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from every pixel to the nearest paint of its image."""
    return _rounded(paint.distance_field(_painted(spark, sf_dir)), "distance")


# maps, tracks, evaluation


@query(f"""WITH l AS ({ROADS}), e AS (SELECT a.link_id AS src, b.link_id AS dst, a.directed FROM l a JOIN l b ON a.b_node = b.a_node AND a.link_id <> b.link_id) SELECT src, dst FROM e UNION SELECT dst, src FROM e WHERE NOT directed""")
def road_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that follow each other by nodes; those without direction also lead back."""
    return lane_graph.topology(tables.roads(spark, sf_dir))


@query(f"""WITH d AS ({DRIVES}), g AS (SELECT 'g' || n_nationkey AS g, n_regionkey AS cam, n_nationkey * 20.0 + 5 AS gx, n_nationkey % 7 * 40.0 + 10 AS gy, (n_nationkey * 10.0)::DOUBLE AS gh FROM nation) SELECT event_id, gh AS guide FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY (x - gx) * (x - gx) + (y - gy) * (y - gy), gh) AS r FROM d JOIN g ON cam = track_id % 5) WHERE r = 1""")
def guide_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    g = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("cctv_id"), (k * 20.0).alias("x1"), (k % 7 * 40.0).alias("y1"), (k * 20.0 + 10.0).alias("x2"), (k % 7 * 40.0 + 20.0).alias("y2"), (k * 10.0).alias("heading_deg"))
    p = tables.drives(spark, sf_dir).select("event_id", (F.col("track_id") % 5).alias("cctv_id"), "x", "y")
    return pipelines.guide(p, g, "event_id").select("event_id", "guide")


@query(f"""WITH d AS ({DRIVES}), s AS (SELECT event_id, 'E' || (track_id % 4) AS link_id, (frame * 7 % 100)::DOUBLE AS s, 1.5 AS d FROM d), l AS ({ROADS}) SELECT event_id, round(ax + s / len * (bx - ax) - d * (b_y - ay) / len, 6) AS x, round(ay + s / len * (b_y - ay) + d * (bx - ax) / len, 6) AS y, round(degrees(atan2(b_y - ay, bx - ax)), 6) AS heading FROM s JOIN l USING (link_id)""")
def states_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.drives(spark, sf_dir).select("event_id", F.col("event_id").alias("row_id"), F.concat(F.lit("E"), (F.col("track_id") % 4).cast("string")).alias("link_id"), (F.col("frame") * 7 % 100).cast("double").alias("s"), F.lit(1.5).alias("d"), F.lit(0.0).alias("heading"))
    return _rounded(matching.rebuild(d, tables.roads(spark, sf_dir)), "x", "y", "heading").select("event_id", "x", "y", "heading")


_STATES = "SELECT event_type AS cctv_id, user_id AS track_id, event_id AS frame, 'L' || event_id % 3 AS link_id, value * 3.6 AS heading, value % 5 - 2.0 AS d FROM events"


@query(f"""WITH s AS ({_STATES}), w AS (SELECT *, lag(link_id) OVER t <> link_id AS changed, abs(heading - lag(heading) OVER t) AS t FROM s WINDOW t AS (PARTITION BY cctv_id, track_id ORDER BY frame)), p AS (SELECT cctv_id, track_id, sum(changed::INT) AS c, (max(frame) - min(frame)) / 10.0 AS span FROM w GROUP BY 1, 2), f AS (SELECT cctv_id, sum(c) / sum(span) AS flicker FROM p WHERE span > 0.2 GROUP BY 1),
 r AS (SELECT cctv_id, median(abs(t - 360 * floor((t + 180) / 360))) AS hm, quantile_cont(abs(t - 360 * floor((t + 180) / 360)), 0.9) AS hp, median(abs(d)) AS lm FROM w GROUP BY 1) SELECT cctv_id, round(flicker, 6) AS flicker_per_s, round(hm, 6) AS heading_median, round(hp, 6) AS heading_p90, round(lm, 6) AS lateral_median FROM r LEFT JOIN f USING (cctv_id)""")
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("cctv_id"), F.col("user_id").alias("track_id"), F.col("event_id").alias("frame"), F.concat(F.lit("L"), (F.col("event_id") % 3).cast("string")).alias("link_id"), (F.col("value") * 3.6).alias("heading"), (F.col("value") % 5 - 2.0).alias("d"))
    return _rounded(summaries.match_metrics(e, 10.0), "flicker_per_s", "heading_median", "heading_p90", "lateral_median")


@query("SELECT event_type AS link_id, round(median(abs(value % 5 - 2.0)), 6) AS lat_med FROM events GROUP BY 1")
def lateral_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("link_id"), (F.col("value") % 5 - 2.0).alias("d"))
    return _rounded(motion_field.lateral_medians(e), "lat_med")


@query("""WITH f AS (SELECT user_id AS link_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS bin, value AS v FROM events), d AS (SELECT abs(v - lag(v) OVER w) AS dv, (v + lag(v) OVER w) / 2 AS m FROM f WINDOW w AS (PARTITION BY link_id ORDER BY bin)) SELECT round(median(dv), 6) AS dv_median, round(quantile_cont(dv, 0.95), 6) AS dv_p95, round(quantile_cont(abs(dv / 3.6 * (m / 3.6) / 5.0), 0.95), 6) AS accel_p95 FROM d WHERE dv IS NOT NULL""")
def field_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read(spark, sf_dir, "events").select(F.col("user_id").alias("link_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("bin"), F.col("value").alias("v_kmh"))
    return _rounded(motion_field.gradients(f, 5.0), "dv_median", "dv_p95", "accel_p95")


@query("SELECT round(100.0 * count(*) FILTER (WHERE event_id % 4 <> 0) / count(*), 6) AS snap_pct, round(median(abs((value * 3.6 - 90) - 360 * floor((value * 3.6 - 90 + 180) / 360))) FILTER (WHERE event_id % 4 <> 0), 6) AS heading_median, median(abs((value * 3.6 - 90) - 360 * floor((value * 3.6 - 90 + 180) / 360))) FILTER (WHERE event_id % 4 <> 0) <= 45 AS ok FROM events")
def snap_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = F.col("event_id") % 4 != 0
    e = read(spark, sf_dir, "events").select(F.when(on, "L").alias("link_id"), F.when(on, F.col("value") * 3.6).alias("snap_heading"), F.lit(90.0).alias("heading"))
    return _rounded(matching.snap_quality(e), "snap_pct", "heading_median")


@query("SELECT event_id AS frame, value AS x, event_id / 25.0::DOUBLE AS t FROM events WHERE event_id % 5 NOT IN (0, 1)")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with finite coordinates alone, with their time."""
    broken = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 10 == 1, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("frame"), broken.alias("x"), F.lit(0.0).alias("y"))
    return sequences.timeline(e, 25.0).select("frame", "x", "t")


_RUN = "SELECT user_id AS track_id, event_type AS kind, event_id AS frame, value AS s, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("frame"), F.col("value").alias("s"))


@query(f"""WITH r AS ({_RUN}), p AS (SELECT *, sum(s) OVER (PARTITION BY track_id, kind ORDER BY k) AS c FROM r), m AS (SELECT i.track_id, i.kind, i.frame, a.k AS a, min((b.c - a.c + a.s) / (b.k - a.k + 1)) AS m FROM p i JOIN p a ON a.track_id = i.track_id AND a.kind = i.kind AND a.k <= i.k JOIN p b ON b.track_id = i.track_id AND b.kind = i.kind AND b.k >= i.k GROUP BY 1, 2, 3, 4)
 SELECT track_id, kind, frame, round(max(m), 6) AS s FROM m GROUP BY 1, 2, 3""")
def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that never fall, nearest in squares."""
    return _rounded(matching.monotone(_runs(spark, sf_dir), ["track_id", "kind"], "frame", "s"), "s").select("track_id", "kind", "frame", "s")


@query(f"""WITH r AS ({_RUN}), st AS (SELECT *, CASE WHEN k > 1 THEN greatest(0.0, s - lag(s) OVER (PARTITION BY track_id, kind ORDER BY k)) END AS v FROM r), f AS (SELECT *, first_value(v) OVER w AS v1, last_value(v) OVER w AS vn, first_value(s) OVER (PARTITION BY track_id, kind ORDER BY k) AS s0, sum(v) OVER (PARTITION BY track_id, kind) AS total,
  sum(v) OVER (PARTITION BY track_id, kind ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w5 FROM st WINDOW w AS (PARTITION BY track_id, kind, v IS NULL ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 m AS (SELECT *, CASE WHEN v IS NOT NULL THEN (w5 + greatest(0, 2 - (k - 2)) * v1 + greatest(0, 2 - (n - k)) * vn) / 5.0 ELSE 0.0 END AS sm FROM f), t AS (SELECT *, sum(sm) OVER (PARTITION BY track_id, kind) AS smt, sum(sm) OVER (PARTITION BY track_id, kind ORDER BY k) AS c FROM m)
 SELECT track_id, kind, frame, round(CASE WHEN n < 3 THEN s WHEN total > 1e-9 AND smt > 1e-9 THEN s0 + c * total / smt ELSE s0 + c END + 1e-9, 6) AS s FROM t""")
def smooth_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the step lifts sums that end in a half off the tie
    return _rounded(matching.progress(_runs(spark, sf_dir), ["track_id", "kind"], "frame", "s", 5).withColumn("s", F.col("s") + 1e-9), "s").select("track_id", "kind", "frame", "s")


@query(f"""WITH d AS ({DRIVES}), w AS (SELECT *, row_number() OVER t AS i, count(*) OVER (PARTITION BY track_id) AS n, coalesce(lag(x) OVER t, x) AS x0, coalesce(lag(y) OVER t, y) AS y0, coalesce(lead(x) OVER t, x) AS x1, coalesce(lead(y) OVER t, y) AS y1 FROM d WINDOW t AS (PARTITION BY track_id ORDER BY frame)),
 c AS (SELECT *, CASE WHEN frame % 4 = 0 THEN heading WHEN sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) >= 0.6 THEN degrees(atan2(y1 - y0, x1 - x0)) END AS near FROM w),
 q AS (SELECT event_id, track_id, i, n, unnest(range(2, n)) AS k FROM c WHERE near IS NULL), p AS (SELECT q.event_id, q.k, b.x - a.x AS dx, b.y - a.y AS dy FROM q JOIN w a ON a.track_id = q.track_id AND a.i = greatest(1, q.i - q.k) JOIN w b ON b.track_id = q.track_id AND b.i = least(q.n, q.i + q.k)),
 f AS (SELECT event_id, arg_min(degrees(atan2(dy, dx)), k) AS far FROM p WHERE sqrt(dx * dx + dy * dy) >= 0.6 GROUP BY 1), v AS (SELECT c.*, coalesce(near, far) AS h FROM c LEFT JOIN f USING (event_id)), m AS (SELECT track_id, degrees(atan2(sum(sin(radians(h))), sum(cos(radians(h))))) AS mean FROM v GROUP BY 1)
 SELECT event_id, round(coalesce(h, mean), 6) AS heading FROM v JOIN m USING (track_id)""")
def heading_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing headings by the chord of the rows around, as many as make it long enough; else the track's mean direction."""
    d = tables.drives(spark, sf_dir).select("event_id", "track_id", "frame", "x", "y", F.when(F.col("frame") % 4 == 0, F.col("heading")).alias("heading"))
    return _rounded(sequences.headings(d, ["track_id"], ["frame"]).select("event_id", "heading"), "heading")


def _apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A true box for each line of an order, all apart."""
    t = tables.boxes(spark, sf_dir).select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("track_id")).distinct()
    return t.select("frame", "track_id", (F.col("track_id") * 200.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("track_id") * 200.0 + 40.0).alias("x2"), F.lit(30.0).alias("y2"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three predictions of each true box, farther and farther off."""
    p = _apart(spark, sf_dir).withColumn("j", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    confidence = (F.col("track_id") * 17 + F.col("j") * 31 + F.col("frame")) % 97 / 100.0 + F.col("track_id") / 1000.0 + F.col("j") / 10000.0
    x = F.col("x1") + F.col("frame") % 5 * 4.0 + F.col("j") * 9.0
    return p.select("frame", (F.col("track_id") * 10 + F.col("j")).alias("tracked_id"), confidence.alias("confidence"), x.alias("x1"), "y1", (x + 40.0).alias("x2"), "y2")


_MATCHED = f"""b AS ({BOXES}), t AS (SELECT DISTINCT l_orderkey AS frame, l_linenumber AS id, l_linenumber * 200.0 AS x FROM b), p AS (SELECT frame, id * 10 + j AS pid, (id * 17 + j * 31 + frame) % 97 / 100.0 + id / 1000.0 + j / 10000.0 AS confidence, x + (frame % 5) * 4.0 + j * 9.0 AS x, id, x AS tx FROM t, (SELECT unnest([0, 1, 2]) AS j)),
 o AS (SELECT *, greatest(0, 40.0 - (x - tx)) / (80.0 - greatest(0, 40.0 - (x - tx))) AS iou FROM p)"""


@query(f"""WITH {_MATCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY frame, id, iou >= 0.5 ORDER BY confidence DESC) AS r FROM o) SELECT frame, round(confidence, 6) AS confidence, iou >= 0.5 AND r = 1 AS tp FROM r""")
def detection_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three predictions of each true box: of those that overlap enough the most confident hits."""
    return _rounded(evaluation.greedy_matches(_apart(spark, sf_dir), _predictions(spark, sf_dir)), "confidence")


@query(f"""WITH {_MATCHED} SELECT frame, id AS track_id, CASE WHEN max(iou) >= 0.5 THEN arg_max(pid, iou) END AS tracked_id FROM o GROUP BY 1, 2""")
def frame_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True boxes and the predictions that overlap them most."""
    t = _apart(spark, sf_dir)
    found = _predictions(spark, sf_dir)
    return evaluation.frame_matches(t, found)


# two true boxes of 40 x 40 and two predictions in each frame, all over one another
_NEAR = """x AS (SELECT DISTINCT l_orderkey AS frame, 0.0::DOUBLE AS t1, 10.0::DOUBLE + l_orderkey % 7 AS t2, l_orderkey % 13 - 3.3::DOUBLE AS p1, l_orderkey % 17 + 1.9::DOUBLE AS p2, l_orderkey % 10 / 10.0::DOUBLE + 0.01::DOUBLE AS c1, l_orderkey % 9 / 10.0::DOUBLE + 0.02::DOUBLE AS c2 FROM lineitem),
 c AS (SELECT *, greatest(0.0, 40 - abs(t1 - p1)) AS a11, greatest(0.0, 40 - abs(t1 - p2)) AS a12, greatest(0.0, 40 - abs(t2 - p1)) AS a21, greatest(0.0, 40 - abs(t2 - p2)) AS a22 FROM x), o AS (SELECT *, a11 / (80 - a11) AS o11, a12 / (80 - a12) AS o12, a21 / (80 - a21) AS o21, a22 / (80 - a22) AS o22 FROM c)"""


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("l_orderkey")
    frames = read(spark, sf_dir, "lineitem").select("l_orderkey").distinct()

    def boxes(name: str, rows: list, *more: str) -> DataFrame:
        listed = F.array(*(F.struct(F.lit(i).alias(name), x.cast("double").alias("x1"), c.alias("confidence")) for i, x, c in rows))
        out = frames.select(k.alias("frame"), F.inline(listed))
        return out.select("frame", name, *more, "x1", F.lit(0.0).alias("y1"), (F.col("x1") + 40.0).alias("x2"), F.lit(40.0).alias("y2"))

    true = boxes("track_id", [(1, F.lit(0.0), F.lit(1.0)), (2, 10.0 + k % 7, F.lit(1.0))])
    return true, boxes("tracked_id", [(1, k % 13 - 3.3, k % 10 / 10.0 + 0.01), (2, k % 17 + 1.9, k % 9 / 10.0 + 0.02)], "confidence")


@query(f"""WITH {_NEAR}, a AS (SELECT *, o11 + o22 >= o12 + o21 AS straight FROM o)
 SELECT frame, 1::BIGINT AS track_id, CASE WHEN straight THEN CASE WHEN o11 >= 0.5 THEN 1 END WHEN o12 >= 0.5 THEN 2 END::BIGINT AS tracked_id FROM a UNION ALL SELECT frame, 2, CASE WHEN straight THEN CASE WHEN o22 >= 0.5 THEN 2 END WHEN o21 >= 0.5 THEN 1 END FROM a""")
def frame_assignment_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True boxes and predictions that overlap each other: the best for one is not the best for both."""
    return evaluation.frame_matches(*_near(spark, sf_dir))


@query(f"""WITH {_NEAR}, s AS (SELECT frame, c1 >= c2 AS one, greatest(c1, c2) AS hi, least(c1, c2) AS lo, CASE WHEN c1 >= c2 THEN o11 ELSE o12 END AS h1, CASE WHEN c1 >= c2 THEN o21 ELSE o22 END AS h2, CASE WHEN c1 >= c2 THEN o12 ELSE o11 END AS l1, CASE WHEN c1 >= c2 THEN o22 ELSE o21 END AS l2 FROM o)
 SELECT frame, round(hi, 6) AS confidence, greatest(h1, h2) >= 0.5 AS tp FROM s UNION ALL SELECT frame, round(lo, 6), CASE WHEN greatest(h1, h2) < 0.5 THEN greatest(l1, l2) WHEN h1 >= h2 THEN l2 ELSE l1 END >= 0.5 FROM s""")
def detection_hits_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that overlap both true boxes: the more confident takes its best, the other has what is left."""
    return _rounded(evaluation.greedy_matches(*_near(spark, sf_dir)), "confidence")


@query(f"""WITH {_MATCHED}, a AS (SELECT frame, id, CASE WHEN max(iou) >= 0.5 THEN arg_max(id * 10 + (pid % 10), iou) END AS got FROM o GROUP BY 1, 2), s AS (SELECT *, lag(got) OVER (PARTITION BY id ORDER BY frame) AS before, row_number() OVER (PARTITION BY id ORDER BY frame) AS r FROM a),
 m AS (SELECT count(*)::BIGINT AS n, count(got)::BIGINT AS hit, count(*) FILTER (WHERE r > 1 AND got IS NOT NULL AND before IS DISTINCT FROM got)::BIGINT AS sw FROM s), h AS (SELECT id, avg((got IS NOT NULL)::INT) AS share FROM a GROUP BY 1)
 SELECT n AS n_truth, 3 * n - hit AS fp, n - hit AS fn, sw AS switches, round(1 - (3 * n - hit + n - hit + sw) / n, 9) AS mota, (SELECT count(*) FILTER (WHERE share >= 0.8) FROM h)::BIGINT AS mostly_tracked, (SELECT count(*) FILTER (WHERE share < 0.2) FROM h)::BIGINT AS mostly_lost FROM m""")
def tracking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking quality of three predictions for each true box."""
    t = _apart(spark, sf_dir)
    found = _predictions(spark, sf_dir)
    m = evaluation.tracking_metrics(t, found)
    names = ("n_truth", "fp", "fn", "switches", "mota", "mostly_tracked", "mostly_lost")
    return spark.createDataFrame([tuple(round(m[n], 9) if n == "mota" else m[n] for n in names)], "n_truth long, fp long, fn long, switches long, mota double, mostly_tracked long, mostly_lost long")


@query(f"""WITH {_MATCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY frame, id, iou >= 0.5 ORDER BY confidence DESC) AS r FROM o), c AS (SELECT count(*)::BIGINT AS n_found, count(*) FILTER (WHERE iou >= 0.5 AND r = 1)::BIGINT AS tp, (SELECT count(*) FROM t)::BIGINT AS n FROM r)
 SELECT n_found, n AS n_truth, round(tp / n_found, 9) AS precision, round(tp / n, 9) AS recall, round(2 * (tp / n_found) * (tp / n) / (tp / n_found + tp / n), 9) AS f1 FROM c""")
def detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of three predictions for each true box."""
    m = evaluation.detection_metrics(_apart(spark, sf_dir), _predictions(spark, sf_dir))
    return spark.createDataFrame([(m["n_found"], m["n_truth"], *(round(m[k], 9) for k in ("precision", "recall", "f1")))], "n_found long, n_truth long, precision double, recall double, f1 double")


# SQL service


@query("""SELECT s_suppkey, round(sqrt(power(s_acctbal - 3, 2) + power(s_nationkey - 4.0, 2)), 6) AS distance, sqrt(power(s_acctbal - 3, 2) + power(s_nationkey - 4.0, 2)) <= 2000 AS near, round((s_acctbal - 90) - 360.0 * floor(((s_acctbal - 90) + 180.0) / 360.0), 6) AS diff FROM supplier""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that user SQL may call beside Spark's own."""
    read(spark, sf_dir, "supplier").createOrReplaceTempView("kerbside_supplier")
    service.QueryService(spark)
    return service.run(spark, "SELECT s_suppkey, round(st_distance(st_makepoint(s_acctbal, double(s_nationkey)), st_makepoint(3D, 4D)), 6) AS distance, st_dwithin(st_makepoint(s_acctbal, double(s_nationkey)), st_makepoint(3D, 4D), 2000D) AS near, round(angdiff(s_acctbal, 90D), 6) AS diff FROM kerbside_supplier")


@query("SELECT event_type AS class, count(DISTINCT user_id)::BIGINT AS n FROM events GROUP BY 1")
def answered_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question, by a generator that writes its SQL in a fence; the rows of the answer."""
    tables.detections(spark, sf_dir).createOrReplaceTempView("detection")
    s = service.QueryService(spark, lambda prompt: "Here:\n```sql\nSELECT class, count(DISTINCT track_id) AS n FROM detection GROUP BY class;\n```")
    return spark.createDataFrame([tuple(r) for r in s.ask("How many objects of each class?", summarise=False)["rows"]], "class string, n long")


@query("""WITH d AS (SELECT event_id, user_id * 1.0 AS x, value AS y FROM events), l AS (SELECT n_nationkey AS k, 'L' || n_nationkey AS link_id, n_nationkey * 60.0 AS ax, n_nationkey % 5 * 20.0 AS y0 FROM nation), t AS (SELECT *, least(1.0, greatest(0.0, (x - ax) / 60.0)) AS t FROM d, l), f AS (SELECT *, sqrt(power(x - (ax + t * 60.0), 2) + power(y - y0, 2)) AS dist FROM t WHERE sqrt(power(x - (ax + t * 60.0), 2) + power(y - y0, 2)) <= 50),
 b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, link_id) AS r FROM f) SELECT d.event_id, link_id, round(dist, 6) AS link_distance FROM d LEFT JOIN b ON b.event_id = d.event_id AND r = 1""")
def detections_on_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of detections with their nearest link."""
    e = read(spark, sf_dir, "events")
    d = e.select("event_id", F.col("event_type").alias("cctv_id"), F.col("user_id").alias("track_id"), F.col("event_type").alias("class"), F.lit(5.0).alias("speed_kmh"), (F.col("user_id") * 1.0).alias("easting"), F.col("value").alias("northing"))
    k = F.col("n_nationkey")
    links = read(spark, sf_dir, "nation").select(F.concat(F.lit("L"), k.cast("string")).alias("link_id"), F.array(F.struct((k * 60.0).alias("x"), (k % 5 * 20.0).alias("y")), F.struct((k * 60.0 + 60.0).alias("x"), (k % 5 * 20.0).alias("y"))).alias("pts"), F.lit(True).alias("directed"))
    service.views(d, tables.cameras(spark, sf_dir), links)
    return _rounded(service.run(spark, "SELECT event_id, link_id, link_distance FROM detection_on_link"), "link_distance")


@query("SELECT l_returnflag AS cctv_id, (l_partkey % 50)::INT AS x, (l_suppkey % 10)::INT AS y, median(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3")
def median_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cctv_id"), (F.col("l_partkey") % 50).cast("int").alias("x"), (F.col("l_suppkey") % 10).cast("int").alias("y"), F.col("l_quantity").alias("value"))
    return masks.median_frame(s)


@query(f"SELECT l_orderkey AS image, least(400.0, x1) AS x1, least(300.0, y1) AS y1, least(400.0, x2) AS x2, least(300.0, y2) AS y2 FROM ({BOXES}) WHERE cctv_id <> 'A' AND x1 < 400 AND y1 < 300")
def painted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir).select(F.col("l_orderkey").alias("image"), F.col("cctv_id").alias("class"), "x1", "y1", "x2", "y2")
    images = b.select("image").distinct().withColumns({"width": F.lit(400), "height": F.lit(300)})
    return taxonomy.unlabelled_regions(images, b, spark.createDataFrame([("A", "car"), ("N", taxonomy.DROP)], "class string, target string"))


@query("SELECT ts::DATE AS day, count(*)::BIGINT AS n FROM events GROUP BY 1")
def dated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark)
    e = read(spark, sf_dir, "events").select("event_id", "ts")
    for part in (0, 1):
        sinks.append_dated(e.where(F.col("event_id") % 2 == part), path)
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS ({DRIVES}), l AS ({ROADS}), t AS (SELECT *, least(1.0, greatest(0.0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / (len * len))) AS t FROM d, l), f AS (SELECT *, sqrt(power(x - (ax + t * (bx - ax)), 2) + power(y - (ay + t * (b_y - ay)), 2)) AS dist FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(dist, 9), link_id) AS r FROM f WHERE dist <= 15) SELECT event_id, link_id, round(degrees(atan2(b_y - ay, bx - ax)), 6) AS bearing FROM r WHERE r = 1""")
def nearest_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spatial_join.nearest_bearing(tables.drives(spark, sf_dir).select("event_id", "x", "y"), tables.roads(spark, sf_dir), "event_id", 15.0), "bearing")


@query("SELECT 10::INT AS z, x::INT AS x, y::INT AS y, ((x - 873) * 256)::INT AS left, ((y - 396) * 256)::INT AS top, 10 * 3 + x + y AS n FROM (SELECT unnest([873, 874]) AS x), (SELECT unnest([396, 397]) AS y)")
def tile_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of a box and their places; the second time they come from the table they were kept in."""

    def get(z: int, x: int, y: int) -> bytes:
        return bytes(z * 3 + x + y)

    def never(z: int, x: int, y: int) -> bytes:
        raise OSError("asked for twice")

    t = pipelines.tiles_of(spark, (126.95, 37.3, 127.5, 37.6), 10)
    path = _fresh(spark)
    pipelines.cached_tiles(t, get, path)
    return pipelines.cached_tiles(t, never, path).select("z", "x", "y", "left", "top", F.octet_length("content").alias("n"))


# road maps

_ROUTES = "SELECT s_suppkey AS k, 127.0 + s_acctbal / 1e4::DOUBLE AS lon, 37.0 + s_nationkey / 1e3 AS lat, 127.001 + s_acctbal / 1e4::DOUBLE AS lon2, 37.0005 + s_nationkey / 1e3 AS lat2 FROM supplier"


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 1e4 + 127.0).alias("lon"), (F.col("s_nationkey") / 1e3 + 37.0).alias("lat"))
    return s.withColumns({"lon2": F.col("lon") + 0.001, "lat2": F.col("lat") + 0.0005})


def _degrees(links: DataFrame) -> DataFrame:
    """Links with their first and last point back in degrees."""
    lon, lat = geodesy.from_utm(F.col("pts")[0]["x"] + 300000.0, F.col("pts")[0]["y"] + 4000000.0, 52)
    lon2, lat2 = geodesy.from_utm(F.element_at("pts", -1)["x"] + 300000.0, F.element_at("pts", -1)["y"] + 4000000.0, 52)
    return _rounded(links.withColumns({"lon": lon, "lat": lat, "lon2": lon2, "lat2": lat2}), "lon", "lat", "lon2", "lat2")


@query(f"""SELECT 'E' || k AS link_id, CASE WHEN k % 3 <> 0 THEN (k % 4)::INT END AS lane_no, 'n' || k AS from_node, round(lon, 6) AS lon, round(lat, 6) AS lat, round(lon2, 6) AS lon2, round(lat2, 6) AS lat2 FROM ({_ROUTES}) WHERE k % 5 <> 0""")
def map_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one layer of a saved map; another layer, and lanes that are no numbers, are in it."""
    k = F.col("k")
    name = k.cast("string")
    properties = F.struct(F.when(k % 3 == 0, "none").otherwise((k % 4).cast("string")).alias("lane_no"), F.concat(F.lit("n"), name).alias("from_node"))
    shape = F.struct(F.lit("LineString").alias("type"), F.array(F.array("lon", "lat"), F.array("lon2", "lat2")).alias("coordinates"))
    feature = F.struct(F.concat(F.lit("E"), name).alias("id"), F.when(k % 5 == 0, "B1").otherwise("A2_LINK").alias("layer"), properties.alias("properties"), shape.alias("geometry"))
    path = _fresh(spark)
    _routes(spark, sf_dir).groupBy((k % 4).alias("part"), F.floor(k / STRETCH).alias("stretch")).agg(F.collect_list(feature).alias("features")).select("features").write.option("maxRecordsPerFile", 1).json(path)
    links = roads.lines(roads.read_features(spark, path), "A2_LINK", 52, (300000.0, 4000000.0))
    return _degrees(links).select("link_id", "lane_no", "from_node", "lon", "lat", "lon2", "lat2")


@query(f"""SELECT k::VARCHAR AS link_id, k % 2 = 0 AS directed, round(lon, 6) AS lon, round(lat, 6) AS lat, round(lon2, 6) AS lon2, round(lat2, 6) AS lat2 FROM ({_ROUTES}) WHERE k % 7 <> 0""")
def street_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of saved street map responses; elements that are no ways are in them."""
    k = F.col("k")
    tags = F.when(k % 2 == 0, F.create_map(F.lit("oneway"), F.lit("yes"))).otherwise(F.create_map(F.lit("highway"), F.lit("primary")))
    points = F.array(F.struct("lat", "lon"), F.struct(F.col("lat2").alias("lat"), F.col("lon2").alias("lon")))
    element = F.struct(F.when(k % 7 == 0, "node").otherwise("way").alias("type"), k.alias("id"), tags.alias("tags"), points.alias("geometry"))
    path = _fresh(spark)
    _routes(spark, sf_dir).groupBy((k % 4).alias("part")).agg(F.collect_list(element).alias("elements")).select("elements").write.option("maxRecordsPerFile", 1).json(path)
    return _degrees(roads.ways(spark, path, 52, (300000.0, 4000000.0))).select("link_id", "directed", "lon", "lat", "lon2", "lat2")


@query("SELECT event_type AS g, floor(event_id / 100)::BIGINT AS t, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a stream over the table's file, drained; the watermark keeps all."""
    from ..streaming import jobs

    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    path = _fresh(spark)
    e.write.parquet(path)
    rows = spark.readStream.schema(e.schema).parquet(path).select(F.col("event_type").alias("class"), F.timestamp_seconds(F.col("event_id")).alias("ts"))
    name = f"kerbside_{uuid.uuid4().hex}"
    run = jobs.counts(jobs.event_time(rows), "100 seconds", "1000 days").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _fresh(spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.col("class").alias("g"), (F.unix_seconds("start") / 100).cast("long").alias("t"), "n")

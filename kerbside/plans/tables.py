"""The driver's tables in the shapes of this engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as detections: the type is camera and class, the user is the track, the number is the frame, the value is the speed."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("frame"), F.col("ts"), F.col("event_type").alias("cctv_id"), F.col("user_id").alias("track_id"), F.col("event_type").alias("class"), F.col("value").alias("speed_kmh"), (F.pmod("event_id", F.lit(100)) / 100.0).alias("confidence"))


DETECTIONS = "SELECT event_id AS frame, ts, event_type AS cctv_id, user_id AS track_id, event_type AS class, value AS speed_kmh, (event_id % 100) / 100.0::DOUBLE AS confidence FROM events"


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras of the events' types; one in two has a name."""
    types = read(spark, sf_dir, "events").select("event_type").distinct()
    return types.select(F.col("event_type").alias("cctv_id"), F.when(F.length("event_type") % 2 == 0, F.upper("event_type")).alias("name"))


CAMERAS = "SELECT DISTINCT event_type AS cctv_id, CASE WHEN length(event_type) % 2 = 0 THEN upper(event_type) END AS name FROM events"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as points of tracks on a plane: seconds since the first event as t."""
    e = read(spark, sf_dir, "events")
    return e.select(F.lit("cam").alias("cctv_id"), F.col("user_id").alias("track_id"), F.col("event_id").alias("frame"), F.col("value").alias("x"), (F.pmod("event_id", F.lit(97)) * 1.0).alias("y"), F.col("event_type").alias("link_id"), F.col("event_type").alias("class"))


TRACKS = "SELECT 'cam' AS cctv_id, user_id AS track_id, event_id AS frame, value AS x, (event_id % 97) * 1.0::DOUBLE AS y, event_type AS link_id, event_type AS class FROM events"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as boxes in an image of 1000 x 700: left from the price, top from the quantity."""
    li = read(spark, sf_dir, "lineitem")
    x1 = F.floor(F.col("l_extendedprice") % 900.0).cast("double")
    y1 = F.floor(F.col("l_quantity") * 12.0).cast("double")
    return li.select(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag").alias("cctv_id"), x1.alias("x1"), y1.alias("y1"), (x1 + 20.0 + F.col("l_linenumber") * 10.0).alias("x2"), (y1 + 15.0 + F.col("l_linenumber") * 5.0).alias("y2"))


BOXES = "SELECT l_orderkey, l_linenumber, l_returnflag AS cctv_id, x1, y1, x1 + 20.0 + l_linenumber * 10.0 AS x2, y1 + 15.0 + l_linenumber * 5.0 AS y2 FROM (SELECT *, floor(l_extendedprice % 900.0)::DOUBLE AS x1, floor(l_quantity * 12.0)::DOUBLE AS y1 FROM lineitem)"


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as a map: 25 junctions 100 m apart, lanes east and north from each, and back west on some; the easternmost roads north run both ways."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("i")).withColumns({"c": F.col("i") % 5, "r": F.floor(F.col("i") / 5).cast("int")})

    def lane(name: str, rows: DataFrame, dx: int, dy: int, side: float, directed: Column = F.lit(True)) -> DataFrame:
        x, y = F.col("c") * 100.0, F.col("r") * 100.0 + side
        pts = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 100.0 * dx).alias("x"), (y + 100.0 * dy).alias("y")))
        node = lambda i: F.concat(F.lit("J"), i.cast("string"))
        return rows.select(F.concat(F.lit(name), F.col("i").cast("string")).alias("link_id"), pts.alias("pts"), directed.alias("directed"), F.lit(None).cast("int").alias("lane_no"), node(F.col("i")).alias("from_node"), node(F.col("i") + dx + 5 * dy).alias("to_node"))

    east, north = lane("E", n.where("c < 4"), 1, 0, 0.0), lane("N", n.where("r < 4"), 0, 1, 0.0, F.col("c") < 4)
    return east.unionByName(north).unionByName(lane("W", n.where("c > 0 and r % 2 = 0"), -1, 0, 4.0))


ROADS = """SELECT *, sqrt(power(bx - ax, 2) + power(b_y - ay, 2)) AS len FROM (
 SELECT 'E' || i AS link_id, c * 100.0 AS ax, r * 100.0 AS ay, c * 100.0 + 100.0 AS bx, r * 100.0 AS b_y, true AS directed, i AS a_node, i + 1 AS b_node FROM (SELECT n_nationkey::INT AS i, (n_nationkey % 5)::INT AS c, (n_nationkey // 5)::INT AS r FROM nation) WHERE c < 4
 UNION ALL SELECT 'N' || i, c * 100.0, r * 100.0, c * 100.0, r * 100.0 + 100.0, c < 4, i, i + 5 FROM (SELECT n_nationkey::INT AS i, (n_nationkey % 5)::INT AS c, (n_nationkey // 5)::INT AS r FROM nation) WHERE r < 4
 UNION ALL SELECT 'W' || i, c * 100.0, r * 100.0 + 4.0, c * 100.0 - 100.0, r * 100.0 + 4.0, true, i, i - 1 FROM (SELECT n_nationkey::INT AS i, (n_nationkey % 5)::INT AS c, (n_nationkey // 5)::INT AS r FROM nation) WHERE c > 0 AND r % 2 = 0)"""


def drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as points on those roads: each user goes east, turns north at a junction and so on, at a speed of their own; one in seven the other way round; one row in five stands."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("value") % 7 - 3.0).alias("side"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.withColumn("frame", k).withColumn("p", (F.col("frame") * (2.0 + F.col("user_id") % 5)) % 400.0).withColumn("leg", F.floor(F.col("p") / 100.0).cast("int"))
    along, back = F.col("p") - F.col("leg") * 100.0, F.col("user_id") % 7 == 0
    step_x, step_y = F.floor((F.col("leg") + 1) / 2) * 100.0, F.floor(F.col("leg") / 2) * 100.0
    east = F.col("leg") % 2 == 0
    x, y = F.when(east, step_x + along).otherwise(step_x + F.col("side")), F.when(east, step_y + F.col("side")).otherwise(step_y + along)
    start = F.col("user_id") % 3 * 100.0
    heading = F.when(east, F.lit(0.0)).otherwise(90.0) + F.when(back, 180.0).otherwise(0.0)
    return rows.select("event_id", F.col("user_id").alias("track_id"), "frame", (x + start).alias("x"), y.alias("y"), heading.alias("heading"), F.when(F.col("event_id") % 5 == 0, 2.0).otherwise(20.0).alias("speed_kmh"))


DRIVES = """SELECT event_id, user_id AS track_id, frame, CASE WHEN leg % 2 = 0 THEN floor((leg + 1) / 2) * 100.0 + p - leg * 100.0 ELSE floor((leg + 1) / 2) * 100.0 + side END + user_id % 3 * 100.0 AS x, CASE WHEN leg % 2 = 0 THEN floor(leg / 2) * 100.0 + side ELSE floor(leg / 2) * 100.0 + p - leg * 100.0 END AS y,
 CASE WHEN leg % 2 = 0 THEN 0.0 ELSE 90.0 END + CASE WHEN user_id % 7 = 0 THEN 180.0 ELSE 0.0 END AS heading, CASE WHEN event_id % 5 = 0 THEN 2.0 ELSE 20.0 END AS speed_kmh
 FROM (SELECT *, floor(p / 100.0)::INT AS leg FROM (SELECT event_id, user_id, value % 7 - 3.0 AS side, frame, (frame * (2.0 + user_id % 5)) % 400.0 AS p FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS frame FROM events)))"""

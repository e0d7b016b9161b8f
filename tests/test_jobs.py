"""Sources, sinks, calibration, masks, alignment, taxonomy, the SQL service, streaming."""

import datetime
import gzip
import json
import struct
import time
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbside import plans, service, sinks
from kerbside.operators import align, calibrate, lane_graph, masks, matching, pipelines, smoother, spatial_join, summaries, taxonomy, tracking, turns
from kerbside.sources import calibration, cameras, datasets, replay, roads
from kerbside.streaming import jobs


def test_replay_round_trip(spark, tmp_path):
    doc = {"location_code": "C1", "meta": {"fps": 10.0, "world": {"epsg": 32652, "origin_easting": 5.0, "origin_northing": 6.0}}, "frames": [{"frame_index": 0, "objects": [{"id": 1, "tracked_id": 3, "class": "car", "bbox_2d": [0, 0, 9, 9], "sat_coords": [1.0, 2.0]}, {"id": 2, "class": "van", "sat_coords": None}]}, {"frame_index": 4, "objects": []}]}
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(json.dumps(doc, indent=2).encode()))
    (tmp_path / "b.json").write_bytes(json.dumps(doc, indent=2).encode())
    (tmp_path / "c.json").write_bytes(gzip.compress(json.dumps(doc).encode()))  # a wrong suffix
    for name in "a.json.gz", "b.json":
        rows = replay.read(spark, str(tmp_path / name))
        assert replay.objects(rows).count() == 1 and replay.objects(rows, located=False).count() == 2
        assert {(r.frame, r.n_objects) for r in replay.frames(rows).collect()} == {(0, 2), (4, 0)}
    assert replay.objects(replay.read_by_content(spark, str(tmp_path / "c.json"))).first().tracked_id == 3
    files = replay.listing(spark, str(tmp_path))
    assert files.count() == 3 and replay.newest(files).count() == 1
    assert replay.largest_original(files).first().path.endswith("b.json")
    sinks.write_replays(replay.objects(replay.read(spark, str(tmp_path / "b.json"))).select("cctv_id", "frame", "id", "class"), str(tmp_path / "out"), ["id", "class"])
    assert spark.read.json(str(tmp_path / "out")).first().frames[0].objects[0].id == 1


def test_source_choice(spark):
    rows = [("A", "x/big.json", 9, False), ("A", "x/reprojected.json", 5, False), ("B", "x/b.json", 9, False), ("B", "pub/b.json", 1, True)]
    out = replay.choose(spark.createDataFrame(rows, "cctv_id string, path string, length long, published boolean")).collect()
    assert {r.path for r in out} == {"x/reprojected.json", "pub/b.json"}


def test_calibration_and_priors(spark, tmp_path):
    c = {"meta": {"location_code": "C1"}, "undistort": {"K": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "D": [0, 0, 0, 0, 0]}, "homography": {"H": [[0.1, 0, 0], [0, 0.1, 0], [0, 0, 1]], "anchors_list": [{"px": [1, 2], "lonlat": [127.0, 37.0]}]}, "parallax": {"z_cam_meters": 8.0}, "world": {"epsg": 32652, "origin_easting": 1.0, "origin_northing": 2.0}}
    (tmp_path / "c.json").write_text(json.dumps(c, indent=1))
    rows = calibration.read(spark, str(tmp_path / "c.json"))
    assert rows.first().use_roi is False and calibration.anchors(rows).first().lon == 127.0
    flat = calibration.flat(rows)
    assert flat.first().h00 == 0.1 and flat.first().cam_z == 8.0 and flat.first().cam_x == 0.0
    (tmp_path / "p.json").write_text(json.dumps({"_note": ["text"], "set1": {"Car": {"width": 1.8, "length": 4.5, "height": 1.5}}}))
    priors = calibration.priors(spark, str(tmp_path / "p.json"))
    assert [tuple(r) for r in priors.collect()] == [("set1", "car", 1.8, 4.5, 1.5)]
    o = spark.createDataFrame([("C1", f, 1, k, [10.0 + f, 10.0, 30.0 + f, 50.0], 0.9) for f in range(12) for k in (" CAR", "tram")], "cctv_id string, frame long, tracked_id long, class string, bbox_2d array<double>, confidence double").withColumn("tracked_id", F.when(F.col("class") == "tram", 2).otherwise(1))
    out = pipelines.reproject(o, flat, priors, 10.0).collect()
    car = [r for r in out if r["class"] == " CAR" and r.frame == 11][0]
    # 5 m apparent, 8 m camera, 1.5 m object: 6.5 / 8 of the way
    assert (car.x, car.y) == pytest.approx(((31 * 0.1) * 6.5 / 8, 5.0 * 6.5 / 8)) and car.speed_kmh is not None
    assert all(r.sat_floor_box is None for r in out if r["class"] == "tram")
    det = pipelines.to_detections(pipelines.reproject(o, flat, priors, 10.0), flat, 52, 10.0)
    assert det.count() == 24 and det.first().easting > 1.0
    assert pipelines.retrack(o, flat, priors, 10.0).where("track_id is not null").count() > 10


def test_camera_directories(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"response": {"data": [{"coordx": "127.1", "coordy": "37.4", "cctvname": "A", "cctvurl": "u"}, {"coordx": "x", "coordy": "1"}, {"coordx": "10", "coordy": "10", "cctvname": "far", "cctvurl": ""}]}}))
    assert [r.name for r in cameras.read_response(spark, str(tmp_path / "r.json"), (127.0, 37.0, 128.0, 38.0)).collect()] == ["A"]
    assert cameras.read_response(spark, str(tmp_path / "r.json")).count() == 2 and cameras.read_response(spark, str(tmp_path / "r.json"), need_url=True).count() == 1
    known = spark.createDataFrame([("a", "A", 127.0, 37.0, True), ("b", "B", 127.01, 37.0, False), ("c", "C", 127.5, 37.0, False)], "cctv_id string, name string, lon double, lat double, has_replay boolean")
    new = spark.createDataFrame([("n", "N", 127.0101, 37.0, True)], known.schema)
    assert {r.cctv_id for r in cameras.upsert(known, new).collect()} == {"a", "c", "n"}
    found = spark.createDataFrame([("x", "A", 128.0, 37.0, False), ("y", "Y", 127.0 + 249.9 / 88800, 37.0, False), ("z", "Z", 127.0 + 250.001 / 88800, 37.0, False)], known.schema)
    assert {r.cctv_id for r in cameras.refresh(known, found).collect()} == {"a", "z"}


def shape(points):
    body = struct.pack("<i4d2i1i", 3, 0, 0, 1, 1, 1, len(points), 0) + b"".join(struct.pack("<2d", *p) for p in points)
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + 8 + len(body)) // 2) + struct.pack("<2i4d", 1000, 3, 1.0, 2.0, 3.0, 4.0) + bytes(32)
    return head + struct.pack(">2i", 1, len(body) // 2) + body


def table(rows):
    field = b"ID".ljust(11, b"\0") + b"C" + bytes(4) + bytes([4, 0]) + bytes(14)
    head = struct.pack("<4BIHH", 3, 1, 1, 1, len(rows), 32 + 32 + 1, 5) + bytes(20)
    return head + field + b"\x0d" + b"".join(b" " + r.encode().ljust(4) for r in rows)


def test_shapefiles_and_features(spark, tmp_path):
    (tmp_path / "l.shp").write_bytes(shape([(127.0, 37.0), (127.1, 37.1)]))
    (tmp_path / "l.dbf").write_bytes(table(["L1"]))
    row = roads.read_shapefiles(spark, str(tmp_path), {"ID": "id"}).first()
    assert row.kind == "LineString" and row.id == "L1" and json.loads(row.coordinates)[1] == [127.1, 37.1]
    b = roads.read_bounds(spark, str(tmp_path)).first()
    assert (b.shape, b.west, b.north) == (3, 1.0, 4.0)
    g = {"type": "FeatureCollection", "features": [{"id": "a", "layer": "link", "properties": {"from_node": "n1", "to_node": "n2", "lane_no": "2"}, "geometry": {"type": "LineString", "coordinates": [[127.0, 37.0, 5.0], [127.001, 37.0, 5.0]]}}, {"id": "b", "layer": "link", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[1, 2]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    link = roads.lines(roads.read_features(spark, str(tmp_path / "g.json")), "link", 52).collect()
    assert len(link) == 1 and link[0].lane_no == 2 and abs(link[0].pts[1].x - link[0].pts[0].x) == pytest.approx(88.9, abs=1.0)
    (tmp_path / "w.json").write_text(json.dumps({"elements": [{"type": "way", "id": 5, "tags": {"oneway": "yes"}, "geometry": [{"lat": 37.0, "lon": 127.0}, {"lat": 37.0, "lon": 127.01}]}, {"type": "node", "id": 1}]}))
    assert roads.ways(spark, str(tmp_path / "w.json"), 52).first().directed is True
    spark.dataSource.register(roads.WaysSource)
    assert spark.read.format("street_ways").load(str(tmp_path / "w.json")).first().id == 5
    assert roads.first_answer(["u1", "u2"], lambda u: (_ for _ in ()).throw(OSError("no")) if u == "u1" else "ok") == "ok"


def test_data_sets(spark, tmp_path):
    (tmp_path / "s1.xml").write_text('<sequence><ignored_region><box left="0" top="0" width="5" height="5"/></ignored_region>' + "".join(f'<frame num="{k}"><target_list><target id="1"><box left="{k}" top="1" width="4" height="4"/><attribute vehicle_type="car"/></target></target_list></frame>' for k in (1, 2, 3)) + "</sequence>")
    boxes, regions = datasets.read_xml_frames(spark, str(tmp_path / "s1.xml"), 2)
    assert sorted(r.frame for r in boxes.collect()) == [1, 3] and regions.first().x2 == 5.0
    (tmp_path / "b.csv").write_text("image,class,x1,y1,x2,y2\n" + "".join(f"i{k},car,0,0,{k},9\n" for k in range(6)))
    assert datasets.read_csv_boxes(spark, str(tmp_path / "b.csv")).count() == 6
    assert {r.image for r in datasets.read_csv_boxes(spark, str(tmp_path / "b.csv"), 2).collect()} == {"i0", "i2", "i4"}
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "labels.zip", "w") as z:
        z.writestr("x/clip1.xml", '<a><image name="f1.jpg"><box label="bus" xtl="1" ytl="2" xbr="3" ybr="4"/></image></a>')
    with zipfile.ZipFile(tmp_path / "z" / "images.zip", "w") as z:
        z.writestr("clip1/cam/f1.jpg", b"")
        z.writestr("clip2/cam/f1.jpg", b"")
    joined = datasets.read_zipped(spark, str(tmp_path / "z" / "labels.zip"), str(tmp_path / "z" / "images.zip")).collect()
    assert [(r.clip, r.member, r["class"], r.x2) for r in joined] == [("clip1", "clip1/cam/f1.jpg", "bus", 3.0)]
    (tmp_path / "c.json").write_text('{"a": "1"}')
    (tmp_path / ".env").write_text("A_KEY='x y'\n# no\na=2\n")
    assert datasets.config(str(tmp_path / "c.json"), str(tmp_path / ".env")) == {"a": "1", "A_KEY": "x y"}
    assert datasets.sequence_frames(100, 4, "even") == [0, 25, 50, 75] and datasets.sequence_frames(10, 5, "seq", 2, 3) == [2, 5, 8]


def test_ground_truth(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"loc": "C", "frames": [{"index": 0}, {"index": 3}], "boxes": [{"frame": 0, "track_id": 1, "class": "car", "bbox": [0, 0, 4, 4]}]}))
    boxes, frames = datasets.read_labels(spark, str(tmp_path / "l.json"))
    assert boxes.first().x2 == 4.0 and frames.count() == 2


def test_cameras_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "det")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "cctv_id string, n long")
    sinks.replace_cameras(rows, path, ["a", "b"])
    sinks.replace_cameras(spark.createDataFrame([("a", 9)], rows.schema), path, ["a", "b"])
    sinks.replace_cameras(spark.createDataFrame([("a", 9)], rows.schema), path, ["a", "b"])
    assert [(r.cctv_id, r.n) for r in spark.read.parquet(path).collect()] == [("a", 9)]


def test_upsert_append_rename_guard(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "cctv_id string, v long, at long"
    sinks.upsert(spark, spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], schema), path, ["cctv_id"], "at")
    sinks.upsert(spark, spark.createDataFrame([("a", 5, 2)], schema), path, ["cctv_id"], "at")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 5, 2), ("b", 2, 1)}
    assert sinks.rename_tables(spark, [path], {"a": "z"}, dry=True) == {path: 1}
    sinks.rename_tables(spark, [path], {"a": "z"})
    assert {r.cctv_id for r in spark.read.parquet(path).collect()} == {"z", "b"}
    with pytest.raises(ValueError, match="not a key"):
        sinks.rename_tables(spark, [path], {"a": "z/.."})
    sinks.append(spark.createDataFrame([("q",)], "cctv_id string"), str(tmp_path / "a"), ["cctv_id", "name"])
    assert spark.read.parquet(str(tmp_path / "a")).first().name is None
    sinks.guard(spark, str(tmp_path / "set"), ["car", "bus"])
    sinks.guard(spark, str(tmp_path / "set"), ["car", "bus"])
    with pytest.raises(ValueError, match="other classes"):
        sinks.guard(spark, str(tmp_path / "set"), ["bus", "car"])


def test_taxonomy(spark):
    m = spark.createDataFrame([("car", "vehicle"), ("dog", taxonomy.DROP), ("x", taxonomy.CONFLICT)], "class string, target string")
    rows = lambda *c: spark.createDataFrame([(v,) for v in c], "class string")
    assert [r.target for r in taxonomy.remap(rows("car", "dog"), m).collect()] == ["vehicle"]
    for bad in ("bus", "x", None):
        with pytest.raises(Exception, match="class without a target"):
            taxonomy.remap(rows("car", bad), m).collect()
    images = spark.createDataFrame([("i1", 100, 50), ("i2", 100, 50)], "image string, width int, height int")
    boxes = spark.createDataFrame([("i1", "car", "vehicle", -10.0, 0.0, 40.0, 25.0), ("i1", "car", "vehicle", 1.0, 1.0, 2.0, 2.0), ("i1", "dog", None, 1.0, 1.0, 20.0, 20.0)], "image string, class string, target string, x1 double, y1 double, x2 double, y2 double")
    files = {r.image: r.text for r in taxonomy.label_files(images, boxes.where("target is not null"), ["vehicle"]).collect()}
    assert files == {"i1": "0 0.200000 0.250000 0.400000 0.500000", "i2": ""}
    assert tuple(taxonomy.build_counts(images, boxes, m).first()) == (2, 1, 1, 1, 1)


H = np.array([[0.05, 0.002, -20.0], [0.001, -0.08, 60.0], [0.0001, 0.001, 1.0]])


def points(n=9, noise=0.0):
    rng = np.random.default_rng(1)
    px = rng.uniform([0, 100], [1000, 600], (n, 2))
    return px, calibrate.apply_homography(H, px) + rng.normal(0, noise, (n, 2)) * (noise > 0)


def test_fits():
    px, xy = points()
    assert calibrate.fit_homography(px, xy) == pytest.approx(H, rel=1e-5, abs=1e-7)
    assert calibrate.leave_one_out(px, xy).max() < 1e-5 and calibrate.leave_one_out(px[:4], xy[:4]) is None
    s = calibrate.similarity(np.array([[0, 0], [1, 0], [0, 1]]), np.array([[2, 3], [2, 5], [0, 3]]))
    assert s == pytest.approx(np.array([[0, -2, 2], [2, 0, 3], [0, 0, 1]]), abs=1e-12)
    assert calibrate.similarity(np.array([[1, 1]]), np.array([[4, 5]]))[:2, 2] == pytest.approx([3, 4]) and (calibrate.similarity(np.zeros((0, 2)), np.zeros((0, 2))) == np.eye(3)).all()
    h, origin = calibrate.save(None, px, xy + 1000.0)
    assert calibrate.apply_homography(h, px) + origin == pytest.approx(xy + 1000.0, abs=1e-4)
    moved, _ = calibrate.save(H, px[:1], xy[:1] + [2.0, -1.0])
    assert calibrate.apply_homography(moved, px) == pytest.approx(xy + [2.0, -1.0], abs=1e-6)
    assert calibrate.save(H, [], [])[0] is H


def test_point_tables(spark):
    px, xy = points(10)
    xy[4] += [30.0, 0.0]
    df = spark.createDataFrame([("C", k, *map(float, p), *map(float, q)) for k, (p, q) in enumerate(zip(px, xy, strict=True))], "cctv_id string, n long, u double, v double, x double, y double")
    kept = {r.n for r in calibrate.drop_outliers(df).collect()}
    assert 4 not in kept and len(kept) >= 6
    row = calibrate.affine_sums(spark.createDataFrame([("C", float(u), float(v), 2 * u + 3 * v + 1.0, u - v + 5.0) for u, v in ((0, 0), (1, 0), (0, 1), (4, 7))], "cctv_id string, u double, v double, x double, y double")).first()
    assert calibrate.solve_affine(row) == pytest.approx(np.array([[2, 3, 1], [1, -1, 5]]), abs=1e-9)
    assert calibrate.loo_rms(calibrate.point_errors(df.where("n < 4"))).count() == 0


def test_pose_and_vanishing_points():
    f, w, h = 900.0, 1280, 720
    k = np.array([[f, 0, w / 2], [0, f, h / 2], [0, 0, 1]])
    m = calibrate.ground_matrix((700.0, 250.0), f, w, h, 8.0)
    r, t = calibrate.pose(np.linalg.inv(m), k)
    assert r @ r.T == pytest.approx(np.eye(3), abs=1e-9) and calibrate.physical(r, t) and abs(float((-r.T @ t)[2])) == pytest.approx(8.0, rel=1e-6)
    again = calibrate.recompose(r, t, f, w / 2, h / 2)
    assert again == pytest.approx(np.linalg.inv(m) / np.linalg.inv(m)[2, 2], rel=1e-6)
    # straight on along the road, points meet in the vanishing point
    far = calibrate.apply_homography(np.linalg.inv(m), np.array([[0.0, 1e7]]))[0]
    assert far == pytest.approx([700.0, 250.0], abs=0.1)
    assert calibrate.focal((640 + 900.0, 360.0), (640 - 900.0, 360.0), w, h) == pytest.approx(900.0) and calibrate.focal((900, 360), (1000, 360), w, h) is None


def test_corners_crossings_and_picks(spark):
    ring = spark.createDataFrame([("p", [(0.0, 0.0), (4.0, 0.0), (8.0, 0.1), (8.0, 5.0), (0.0, 5.0)])], "poly_id string, pts array<struct<x:double,y:double>>")
    assert sorted(r.n for r in calibrate.corners(ring).collect()) == [0, 2, 3, 4]
    seg = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (2, 0.0, 4.0, 4.0, 0.0), (3, 50.0, 50.0, 60.0, 60.0)], "seg_id long, ax double, ay double, bx double, by double")
    assert [(r.a, r.b, r.x, r.y) for r in calibrate.crossings(seg).collect()] == [(1, 2, 2.0, 2.0)]
    c = pd.DataFrame({"u": [10, 12, 900, 500], "v": [10, 12, 10, 500], "score": [0.9, 0.8, 0.5, 0.1]})
    assert list(calibrate.spread_pick(c, 1000, 600, 3).index) == [0, 2, 3]


def test_masks(spark):
    mask = spark.createDataFrame([("C", x, y) for x in range(3, 7) for y in range(2, 4)] + [("C", 20, 20), ("C", 21, 21)], "cctv_id string, x int, y int")
    area = masks.summed_area(mask)
    boxes = spark.createDataFrame([(1, "C", 3, 2, 7, 4), (2, "C", 0, 0, 5, 4), (3, "C", 30, 30, 40, 40), (4, "C", 4, 2, 4, 9)], "box_id long, cctv_id string, x1 int, y1 int, x2 int, y2 int")
    got = {r.box_id: (r.masked, round(r.share, 4)) for r in masks.coverage(boxes, area).collect()}
    assert got == {1: (8, 1.0), 2: (4, 0.2), 3: (0, 0.0), 4: (0, 0.0)}
    assert {r.box_id for r in masks.inside(boxes, area).collect()} == {1, 2}
    assert {r.box_id for r in masks.inside(boxes.withColumns({"x2": F.col("x2") - 1, "y2": F.col("y2") - 1}), area, "in").collect()} == {1}
    blobs = masks.regions(mask).orderBy("region").collect()
    assert [(b.region, b.area) for b in blobs] == [(0, 8), (1, 2)]
    line = spark.createDataFrame([("l", float(k), 0.1 * (k % 2)) for k in range(9)] + [("b", float(k % 3), float(k // 3)) for k in range(9)], "g string, x double, y double")
    assert [r.g for r in masks.elongated(line, ["g"]).collect()] == ["l"]
    road = spark.createDataFrame([("C", 1, 0.0, 0.0, 10.0, 10.0)], "cctv_id string, frame long, x1 double, y1 double, x2 double, y2 double")
    assert masks.road_cells(road, 10, 1).count() == 9


def test_alignment(spark):
    field = spark.createDataFrame([(x, y, abs(x - 10) * 1.0) for x in range(21) for y in range(21)], "x int, y int, value double")
    pts = spark.createDataFrame([(k, 7.0 + 0.5, 2.0 + k % 15) for k in range(30)], "id long, x double, y double")
    cost = align.surface(pts, field, align.grid(spark, 5.0, 1.0), 1.0, 6.0)
    assert align.best_shift(cost).first().dx == 3.0 and align.contrast(cost).first().contrast == pytest.approx(1.0)
    assert align.anisotropy(cost, 0.5).first().major > 0
    v = {r.id: r.value for r in align.bilinear(spark.createDataFrame([(1, 4.5, 3.0), (2, 99.0, 1.0)], "id long, x double, y double"), field, -1.0).collect()}
    assert v == {1: 5.5, 2: -1.0}
    a, b = (spark.createDataFrame([(k, float(k), d) for k in range(5)], "id long, x double, y double") for d in (0.0, 0.5))
    assert align.chamfer(a, b, 3.0, both_ways=True).first().chamfer == pytest.approx(0.5)
    x, c = align.refine(lambda p: float((p[0] - 1.3) ** 2 + (p[1] + 0.4) ** 2), np.zeros(2), np.ones(2))
    assert x == pytest.approx([1.3, -0.4], abs=1e-3) and align.refine(lambda p: float(-p[0]), np.zeros(1), np.ones(1), np.array([[-1.0], [2.0]]))[0][0] == pytest.approx(2.0, abs=1e-3)
    tiles = align.local_shifts(pts, field, align.grid(spark, 5.0, 1.0), 1.0, 6.0, 50.0, least=10, reach=5.0).collect()
    assert len(tiles) == 1 and tiles[0].dx == 3.0
    line = spark.createDataFrame([("a", [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0)])], "link_id string, pts array<struct<x:double,y:double>>")
    assert [(r.x, r.y) for r in align.densify(line, 1.0).orderBy("n", "i").collect()] == [(0, 0), (1, 0), (2, 0), (2, 1)]


def test_flipped_links_and_rebuilt_objects(spark):
    links = spark.createDataFrame([("a", [(9.0, 0.0), (0.0, 0.0)], True, 1, "n", "m")], "link_id string, pts array<struct<x:double,y:double>>, directed boolean, lane_no int, from_node string, to_node string")
    nodes = spark.createDataFrame([("n", 0.0, 0.0)], "node_id string, x double, y double")
    right = lane_graph.flip_by_node(links, nodes)
    assert right.first().flipped and right.first().pts[0].x == 0.0
    states = spark.createDataFrame([("r", "a", 4.0, 1.0, 170.0, 4.0, 2.0)], "row_id string, link_id string, s double, d double, heading double, length double, width double")
    r = matching.rebuild(states, right.withColumn("directed", F.lit(False)).drop("flipped")).first()
    assert (r.x, r.y, r.heading) == pytest.approx((4.0, 1.0, -180.0)) and len(r.sat_floor_box) == 4


def test_match_metrics_and_guides(spark):
    s = spark.createDataFrame([("c", "t", k, "a" if k < 5 else "b", 179.0 if k % 2 else -179.0, 0.5) for k in range(11)], "cctv_id string, track_id string, frame long, link_id string, heading double, d double")
    m = summaries.match_metrics(s, 10.0).first()
    assert m.flicker_per_s == pytest.approx(1.0) and m.heading_median == pytest.approx(2.0) and m.lateral_median == 0.5
    g = spark.createDataFrame([("c", 0.0, 0.0, 2.0, 0.0, 15.0), ("c", 50.0, 0.0, 52.0, 0.0, 95.0)], "cctv_id string, x1 double, y1 double, x2 double, y2 double, heading_deg double")
    p = spark.createDataFrame([("p", "c", 40.0, 0.0)], "row_id string, cctv_id string, x double, y double")
    assert pipelines.guide(p, g).first().guide == 95.0
    r = pipelines.round_coordinates(spark.createDataFrame([([[127.123456789, 37.1, 5.0]],)], "coordinates array<array<double>>")).first()
    assert r.coordinates == [[127.1234568, 37.1]]
    t = spark.createDataFrame([(1, 2, 3), (1, 0, 0)], "z int, x int, y int")

    def get(z, x, y):
        if x == 0:
            raise OSError("gone")
        return bytes([z, x, y])

    assert {bytes(r.content or b"") for r in pipelines.fetch_tiles(t, get).collect()} == {b"\x01\x02\x03", b""}


def test_link_ends(spark):
    links = spark.createDataFrame([("a", [(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)])], "link_id string, pts array<struct<x:double,y:double>>")
    r = turns.link_ends(links).first()
    assert (r.start_bearing, r.end_bearing) == (0.0, 90.0)
    assert spatial_join.segments(links).orderBy("n").collect()[1].s0 == 1.0


@pytest.mark.parametrize("sql", ["SELECT 1 AS a", "WITH t AS (SELECT 1 AS a) SELECT * FROM t", "SELECT ';' AS a", "SELECT 'drop table x' AS a", "(SELECT 1 AS a) UNION ALL (SELECT 2)", "SELECT a FROM (VALUES (1), (2)) v(a) ORDER BY a LIMIT 1", "SELECT count(*) FILTER (WHERE id > 2) AS a FROM range(5)", "SELECT id AS a, rank() OVER (ORDER BY id) AS r FROM range(3)", "SELECT /* c */ 1 AS a -- x"])
def test_queries_pass_the_gate(spark, sql):
    assert service.run(spark, sql).columns


@pytest.mark.parametrize("sql", ["DROP TABLE x", "INSERT INTO t SELECT 1", "SELECT 1; SELECT 2", "SET a=b", "CREATE TABLE t AS SELECT 1", "SELECT FROM (", "", "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t", "TRUNCATE TABLE x", "EXPLAIN SELECT 1", "select * from t where delete"])
def test_others_do_not(spark, sql):
    with pytest.raises(service.Refused):
        service.run(spark, sql)


_REFLECT = "reflect('java.lang.System', 'getProperty', 'user.dir')"
_FILE = "parquet.`/root/testdata/sf0.001/region.parquet`"


@pytest.mark.parametrize(
    "sql",
    [
        f"SELECT {_REFLECT}", "SELECT java_method('java.lang.System', 'getenv')", "SELECT try_reflect('java.lang.System', 'getenv')", f"SELECT * FROM {_FILE}",
        f"SELECT * FROM gate_view WHERE load = {_REFLECT}", f"SELECT (SELECT {_REFLECT})", f"SELECT 1 WHERE EXISTS (SELECT 1 FROM {_FILE})", f"SELECT 1 WHERE 1 IN (SELECT r_regionkey FROM {_FILE})",
        f"WITH a AS (SELECT {_REFLECT} AS x) SELECT * FROM a", f"WITH a AS (WITH b AS (SELECT * FROM {_FILE}) SELECT * FROM b) SELECT * FROM a", f"SELECT count(*) OVER w FROM gate_view WINDOW w AS (PARTITION BY {_REFLECT})",
        f"SELECT sum(load) FILTER (WHERE {_REFLECT} = 'x') FROM gate_view", f"SELECT transform(array(1), x -> {_REFLECT})", f"SELECT * FROM gate_view LATERAL VIEW explode(array({_REFLECT})) t AS x", f"SELECT * FROM gate_view, LATERAL (SELECT {_REFLECT})",
        f"SELECT * FROM VALUES ({_REFLECT})", f"SELECT load FROM gate_view GROUP BY load HAVING max({_REFLECT}) = 'x'", f"SELECT load FROM gate_view ORDER BY {_REFLECT}", f"SELECT * FROM gate_view JOIN gate_view b ON {_REFLECT} = 'x'",
        "SELECT input_file_name() FROM gate_view", "SELECT * FROM gate_table_unknown", "SELECT * FROM default.gate_view", "SELECT * FROM sql_keywords()", "SELECT system.builtin.reflect('java.lang.System', 'getenv')", "SELECT current_database()", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv')",
        "SELECT * FROM IDENTIFIER('gate_view')", "SELECT TRANSFORM(load) USING 'cat' FROM gate_view", "SELECT gate_own(load) FROM gate_view", f"SELECT * FROM (WITH c AS (SELECT 1) SELECT * FROM c) JOIN (SELECT * FROM c)",
        f"SELECT * FROM gate_view PIVOT (max({_REFLECT}) FOR load IN (1, 2))", f"SELECT * FROM range(length({_REFLECT}))", f"SELECT 1 LIMIT length({_REFLECT})", f"SELECT CASE WHEN {_REFLECT} = 'x' THEN 1 END", f"SELECT load FROM gate_view UNION ALL SELECT {_REFLECT}",
    ],
)
def test_the_gate_sees_every_part_of_a_query(spark, sql):
    gate_view(spark)
    spark.udf.register("gate_own", lambda x: x, "long")
    with pytest.raises(service.Refused):
        service.check(spark, sql)


def gate_view(spark):
    spark.createDataFrame([(1, 2)], "load long, `set` long").createOrReplaceTempView("gate_view")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT load, `set` AS use FROM gate_view", "SELECT 'DROP TABLE x; --' AS replace", "WITH a AS (SELECT load FROM gate_view), b AS (SELECT * FROM a) SELECT * FROM b", "SELECT sum(load) OVER w FROM gate_view WINDOW w AS (ORDER BY load)",
        "SELECT * FROM gate_view WHERE load IN (SELECT load FROM gate_view) AND EXISTS (SELECT 1)", "SELECT transform(array(1, 2), x -> x + 1)", "SELECT * FROM gate_view LATERAL VIEW explode(array(1, 2)) t AS x", "SELECT * FROM range(3)", "/* a */ SELECT 1 -- b",
        "SELECT st_distance(st_makepoint(0D, 0D), st_makepoint(3D, 4D))", "SELECT load FROM gate_view UNION SELECT 1 ORDER BY 1 LIMIT 3", "SELECT percentile(load, 0.5), stddev(load) FROM gate_view GROUP BY ROLLUP (`set`) HAVING count(*) > 0", "SELECT * FROM gate_view PIVOT (max(`set`) FOR load IN (1, 2))",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT max(n) FROM r",
    ],
)
def test_reading_queries_pass(spark, sql):
    gate_view(spark)
    service.QueryService(spark)
    assert service.run(spark, sql).collect()


@pytest.mark.parametrize(
    "answer,sql",
    [
        ("SELECT 1;", "SELECT 1"), ("Here it is:\n```sql\nSELECT 1\nFROM t;\n```\nand more SELECT", "SELECT 1\nFROM t"), ("```SELECT 2```", "SELECT 2"), ("<think>SELECT 0</think> with t as (select 1) select * from t", "with t as (select 1) select * from t"),
        ("<think>a\nb</think>\nI go with this: SELECT 3", "SELECT 3"), ("no query", "no query"), ("", ""), ("```\n(SELECT 1) UNION (SELECT 2)\n```", "(SELECT 1) UNION (SELECT 2)"),
    ],
)
def test_extract_sql(answer, sql):
    assert service.extract_sql(answer) == sql


def test_service(spark):
    d = spark.createDataFrame([("c", k % 3, "car", float(k), 100.0 + k, 5.0) for k in range(60)], "cctv_id string, track_id long, class string, speed_kmh double, easting double, northing double")
    links = spark.createDataFrame([("L", [(90.0, 0.0), (200.0, 0.0)], True)], "link_id string, pts array<struct<x:double,y:double>>, directed boolean")
    assert service.views(d, spark.createDataFrame([("c", "Cam")], "cctv_id string, name string"), links) == ["detection", "cctv", "cctv_summary", "detection_on_link"]
    s = service.QueryService(spark, lambda p: "<think>DROP</think>Sure:\n```sql\nWITH a AS (SELECT name, n_objects FROM cctv_summary) SELECT * FROM a;\n```" if p.startswith("Write") else " One camera. ")
    out = s.ask("which?")
    assert out["rows"] == [["Cam", 3]] and out["answer"] == "One camera." and not out["truncated"]
    assert "detection(" in s.prompt("x") and "st_distance" in s.schema_text()
    many = s.sql("SELECT * FROM detection_on_link")
    assert len(many["rows"]) == service.RETURN_ROWS and many["truncated"] and many["rows"][0][many["columns"].index("link_id")] == "L"
    assert "error" in s.sql("DROP VIEW detection") and s.sql("SELECT double('nan') AS x, DATE'2024-01-02' AS d, 1.5BD AS c")["rows"] == [[None, "2024-01-02", 1.5]]
    one = s.sql("SELECT st_distance(st_makepoint(0D, 0D), st_makepoint(3D, 4D)) AS a, st_dwithin(st_makepoint(0D, 0D), st_makepoint(3D, 4D), 4D) AS b, round(st_distance_deg(127D, 37D, 127D, 38D)) AS c, angdiff(10D, 350D) AS d, turn_label(0D, 90D) AS e, round(wilson_lo(5, 10), 4) AS f, wilson_hi(0, 0) AS g")
    assert one["rows"] == [[5.0, False, 111195.0, 20.0, "left", 0.2366, 1.0]]
    with pytest.raises(ValueError):
        service.QueryService(spark).ask("x")


@pytest.mark.parametrize("sql", ["SELECT repeat('x', 2000000000)", "SELECT space(2000000)", "SELECT rpad('x', 3000000, 'y')", "SELECT size(sequence(1, 2000000))", "SELECT size(array_repeat(1, 1000 * 1000 * 1000))", "SELECT repeat(s, 2000) FROM (SELECT repeat('x', 2000) AS s)", "SELECT repeat('x', load) FROM (SELECT 5 AS load)"])
def test_values_that_fill_the_memory_are_refused(spark, sql):
    with pytest.raises(service.Refused):
        service.check(spark, sql)


def test_small_growth_passes_and_long_answers_stop(spark):
    s = service.QueryService(spark, seconds=3.0)
    assert s.sql("SELECT repeat('ab', 3) AS r, size(sequence(1, 100)) AS n, lpad('7', 3, '0') AS l")["rows"] == [["ababab", 100, "007"]]
    began = time.time()
    out = s.sql("SELECT count(*) AS n FROM range(1000000000000) WHERE id * 31 % 7 = 3")
    assert out["error"] == "took more than 3 seconds" and time.time() - began < 30
    assert s.sql("SELECT 1 AS a")["rows"] == [[1]]


def stream(spark, tmp_path, pdf, schema, name):
    """Three files of rows in order, one for each micro-batch."""
    path = tmp_path / name
    path.mkdir()
    for k, part in enumerate(np.array_split(np.arange(len(pdf)), 3)):
        spark.createDataFrame(pdf.iloc[part], schema).coalesce(1).write.parquet(str(path / f"{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def drain(df, spark, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return spark.table(name).toPandas()


def test_stream_smoother_equals_the_batch(spark, tmp_path):
    pdf = pd.DataFrame([("c", str(t), f, float(f * (1 + t)), 0.1 * (f % 3)) for f in range(30) for t in range(3)], columns=["cctv_id", "track_id", "frame", "x", "y"])
    schema = "cctv_id string, track_id string, frame long, x double, y double"
    got = drain(jobs.smooth(stream(spark, tmp_path, pdf, schema, "s"), 10.0, idle_ms=None), spark, "out_smooth").sort_values(["track_id", "frame"])
    want = smoother.smooth(spark.createDataFrame(pdf, schema), ["cctv_id", "track_id"], 10.0).toPandas().sort_values(["track_id", "frame"])
    assert got.speed_kmh.fillna(-1).tolist() == pytest.approx(want.speed_kmh.fillna(-1).tolist()) and got.heading.fillna(-1).tolist() == pytest.approx(want.heading.fillna(-1).tolist())


def test_stream_tracker_equals_the_batch(spark, tmp_path):
    _, found = tracking.simulate(1, frames=60)
    cut = [found[(found.frame >= a) & (found.frame < b)] for a, b in ((0, 20), (20, 40), (40, 60))]
    schema = "frame long, x double, y double, confidence double, cctv_id string, class string"
    path = tmp_path / "t"
    path.mkdir()
    for k, part in enumerate(cut):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path / f"{k}"))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))
    got = drain(jobs.track(rows, 30.0, idle_ms=None), spark, "out_track")
    want = tracking.track(spark.createDataFrame(found, schema), 30.0).toPandas()
    key = lambda d: sorted(zip(d.frame, d.x, d.y, d.track_id.fillna("").str.replace("^0-", "", regex=True), strict=True))
    assert found.frame.min() == 0 and key(got) == key(want)


def test_stream_state_expires_by_event_time(spark, tmp_path):
    """A camera that comes back after more than `idle_ms` of event time begins anew, with other ids, however fast the stream runs."""
    at = datetime.datetime(2024, 1, 1)
    frames = [*range(0, 30), *range(9000, 9030), *range(9030, 9032)]  # another camera moves the watermark on
    rows = [("a", f, float(f % 9000), 0.0, 0.9, "car", at + datetime.timedelta(seconds=f / 30)) for f in frames[:60]]
    parts = [rows[:30], [("b", 6000, 0.0, 0.0, 0.9, "car", at + datetime.timedelta(seconds=200))], [("b", 6001, 0.0, 0.0, 0.9, "car", at + datetime.timedelta(seconds=201))], rows[30:]]
    schema = "cctv_id string, frame long, x double, y double, confidence double, class string, ts timestamp"
    path = tmp_path / "e"
    path.mkdir()
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path / f"{k}"))
    stream_ = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))
    got = drain(jobs.track(stream_, 30.0, idle_ms=10_000, late="1 second"), spark, "out_event")
    ids = got[got.cctv_id == "a"].dropna(subset=["track_id"])
    assert set(ids[ids.frame < 30].track_id) == {"0-1"} and set(ids[ids.frame >= 9000].track_id) == {"9000-1"}
    with pytest.raises(ValueError):
        jobs.smooth(stream_, 30.0, idle_ms=None, late="1 second")


def test_stream_rows_without_a_point_and_rows_that_come_again(spark, tmp_path):
    """Nulls stay null and change nothing; a frame that comes again, or late, is dropped; equal to the batch of the rest."""
    rows = [("a", f, float(f), 0.0, 0.9, "car") for f in range(12)] + [("a", f, None, 0.0, 0.9, "car") for f in range(12)] + [(None, 3, 5.0, 5.0, 0.9, None), ("a", None, 1.0, 1.0, 0.9, "car")]
    again = [("a", 2, 2.0, 0.0, 0.9, "car"), ("a", 12, 12.0, 0.0, 0.9, "car"), ("b", 12, None, None, 0.9, "car")]
    schema = "cctv_id string, frame long, x double, y double, confidence double, class string"
    path = tmp_path / "n"
    path.mkdir()
    for k, part in enumerate((rows, again, [("a", 13, 13.0, 0.0, 0.9, "car"), ("a", 5, 9.0, 9.0, 0.9, "car")])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path / f"{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))
    got = drain(jobs.track(source.withColumn("track_id", F.lit("x")), 30.0, idle_ms=None), spark, "out_null_track")
    assert len(got) == 12 + 12 + 2 + 2 + 1
    placed = got[(got.cctv_id == "a") & got.x.notna() & got.frame.notna()]
    assert sorted(placed.frame) == list(range(14)) and set(placed.track_id) == {"0-1"}
    assert got[got.x.isna() | got.frame.isna()].track_id.isna().all()
    smoothed = drain(jobs.smooth(source.withColumn("track_id", F.when(F.col("frame") != 7, F.lit("t"))), 10.0, idle_ms=None), spark, "out_null_smooth")
    on = smoothed[(smoothed.track_id == "t") & smoothed.x.notna() & smoothed.frame.notna() & (smoothed.cctv_id == "a")].sort_values("frame")
    assert on.frame.tolist() == [0, 1, 2, 3, 4, 5, 6, *range(8, 14)] and on.speed_kmh.iloc[-1] == pytest.approx(36.0)
    assert smoothed[smoothed.track_id.isna() | smoothed.x.isna()].speed_kmh.isna().all()


def test_stream_writes_the_tracks_it_touches(spark, tmp_path, monkeypatch):
    """Of a camera's many live tracks a batch writes those with detections; the others are predicted from their last one and live on."""
    settings = tracking.Settings(max_age=50)
    rows = [[("a", f, 100.0 * t + f, 0.0, 0.9, "car") for t in range(20) for f in range(4)], [("a", f, 100.0 + f, 0.0, 0.9, "car") for f in range(4, 8)], [("a", f, 100.0 * t + f, 0.0, 0.9, "car") for t in range(20) for f in range(8, 10)]]
    schema = "cctv_id string, frame long, x double, y double, confidence double, class string"
    path = tmp_path / "m"
    path.mkdir()
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path / f"{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))
    q = jobs.track(source, 10.0, settings, idle_ms=None).writeStream.format("memory").queryName("out_touched").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    # a batch's updates: the tracks touched and the camera
    assert updated == [21, 2, 21]
    want = tracking.track(spark.createDataFrame([r for part in rows for r in part], schema), 10.0, settings).toPandas()
    got = spark.table("out_touched").toPandas()
    key = lambda d: sorted(zip(d.frame, d.x, d.track_id.str.replace("^0-", "", regex=True), strict=True))
    assert key(got) == key(want)


def test_tracking_on_lanes_in_a_stream_equals_the_batch(spark):
    """Every event on the roads; coasting along lanes survives the state store, and matters."""
    from kerbside.plans import track_queries

    sf = "/root/testdata/sf0.001"
    graph, rows = track_queries.lanes(spark, sf), track_queries.driven(spark, sf)
    want = plans.QUERIES["ground_tracker_lanes"](spark, sf).toPandas()
    got = track_queries._streamed(spark, rows, lambda r: jobs.track(r, 1.0, graph=graph, idle_ms=None)).toPandas()
    keys = ["cctv_id", "frame", "x", "y"]
    both = got.merge(want, on=keys)
    assert len(both) == len(want) == rows.count() and (both.track_id_x.isna() == both.track_id_y.isna()).all()
    some = both.dropna(subset=["track_id_x"])
    a, b = some.cctv_id + some.track_id_x, some.cctv_id + some.track_id_y
    assert len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True))) > 10
    free = tracking.track(rows, 1.0).toPandas().merge(want, on=keys)
    assert (free.track_id_x != free.track_id_y).any()


def test_similarity_fits_equal_the_single_fit(spark):
    rng = np.random.default_rng(4)
    src = rng.normal(0, 30, (40, 2))
    dst = 2.0 * src @ np.array([[0.8, 0.6], [-0.6, 0.8]]) + [5.0, -7.0] + rng.normal(0, 0.1, (40, 2))
    rows = [("a", *map(float, p), *map(float, q)) for p, q in zip(src, dst, strict=True)] + [("one", 1.0, 2.0, 4.0, 6.0), ("one", 1.0, 2.0, 4.0, 8.0), ("a", None, 1.0, 1.0, 1.0)]
    out = {r.cctv_id: r for r in calibrate.similarity_fits(spark.createDataFrame(rows, "cctv_id string, u double, v double, x double, y double")).collect()}
    m = calibrate.similarity(src, dst)
    assert [out["a"][c] for c in "abcdef"] == pytest.approx(m[:2].ravel().tolist()) and out["a"].n == 40
    assert [out["one"][c] for c in "abcdef"] == pytest.approx([1.0, 0.0, 3.0, 0.0, 1.0, 5.0])


@pytest.mark.parametrize("name", ["smoother", "tracker"])
def test_streams_over_the_whole_table_equal_the_batches(spark, name):
    """Every event, in three micro-batches: the same speeds and headings, and the same grouping of detections to tracks."""
    sf = "/root/testdata/sf0.001"
    got = plans.QUERIES[f"stream_{name}"](spark, sf).toPandas()
    want = plans.QUERIES["track_smoother" if name == "smoother" else "ground_tracker"](spark, sf).toPandas()
    assert len(got) == len(want) > 0
    if name == "smoother":
        got["track_id"] = got.track_id.astype(int)
        both = got.merge(want, on=["track_id", "frame"])
        assert len(both) == len(want)
        for c in ("speed_kmh", "heading"):
            assert both[f"{c}_x"].fillna(-999).tolist() == pytest.approx(both[f"{c}_y"].astype(float).fillna(-999).tolist())
    else:
        both = got.merge(want, on=["cctv_id", "frame", "x", "y"])
        assert len(both) == len(want) and (both.track_id_x.isna() == both.track_id_y.isna()).all()
        some = both.dropna(subset=["track_id_x"])
        a, b = some.cctv_id + some.track_id_x, some.cctv_id + some.track_id_y
        assert len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True))) > 10


def test_stream_windows(spark, tmp_path):
    pdf = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00:10", "2024-01-01 00:00:50", "2024-01-01 00:01:10", "2024-01-01 00:30:00", "2024-01-01 00:00:20", "2024-01-01 02:00:00"]), "class": "car", "track_id": 1})
    schema = "ts timestamp, class string, track_id long"
    got = drain(jobs.counts(stream(spark, tmp_path, pdf.iloc[[0, 1, 2, 3, 5]], schema, "w")), spark, "out_counts")
    assert sorted(got.n.tolist()) == [1, 1, 2]
    got = drain(jobs.sessions(stream(spark, tmp_path, pdf.iloc[[0, 1, 2, 3, 5]], schema, "v")), spark, "out_sessions")
    assert sorted(got.n.tolist()) == [1, 3]


def test_jobs_of_the_command_line(spark, tmp_path, capsys):
    from kerbside.__main__ import JOBS, main
    from kerbside.plans import tables

    sf, at = "/root/testdata/sf0.001", lambda name: str(tmp_path / name)
    tables.drives(spark, sf).withColumn("cctv_id", F.lit("c")).withColumn("class", F.lit("car")).write.parquet(at("tracks"))
    tables.roads(spark, sf).write.parquet(at("links"))
    main(["mapmatch", "--tracks", at("tracks"), "--links", at("links"), "--method", "viterbi", "--out", at("states")], spark)
    states = spark.read.parquet(at("states"))
    assert states.count() == spark.read.parquet(at("tracks")).count() and states.where("link_id is not null").count() > 0
    main(["turn-counts", "--states", at("states"), "--links", at("links"), "--out", at("turns")], spark)
    assert {"left", "straight"} & {r.turn for r in spark.read.parquet(at("turns")).collect()}
    main(["field", "--states", at("states"), "--links", at("links"), "--out", at("field")], spark)
    assert spark.read.parquet(at("field")).count() == 52 * 10
    main(["split", "--tracks", at("tracks"), "--limit", "1e9", "--out", at("split")], spark)
    tables.detections(spark, sf).write.parquet(at("detections"))
    tables.cameras(spark, sf).write.parquet(at("cameras"))
    main(["summary", "--detections", at("detections"), "--cameras", at("cameras")], spark)
    assert "avg_speed_kmh" in capsys.readouterr().out
    b = spark.createDataFrame([(f, 1, 0.9, 0.0, 0.0, 9.0, 9.0) for f in range(5)], "frame long, track_id long, confidence double, x1 double, y1 double, x2 double, y2 double")
    b.write.parquet(at("truth"))
    b.withColumnRenamed("track_id", "tracked_id").write.parquet(at("found"))
    main(["evaluate", "--truth", at("truth"), "--found", at("found")], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["mota"] == 1.0
    main(["rename", at("tracks"), "--names", "c=d"], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {at("tracks"): states.count()}
    assert len(JOBS) == 15


def test_workbooks(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>%s</sheetData></worksheet>'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t> YCOORD</t></is></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>127.1</v></c><c r="C2"><v>37.4</v></c></row><row r="3"><c r="B3"><v>129.0</v></c><c r="C3"><v>35</v></c></row>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>CCTVID</t></si><si><t>XCOORD</t></si><si><r><t>cam </t></r><r><t>one</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet % rows)
    table = cameras.workbook_table(cameras.read_workbook(spark, str(tmp_path / "a.xlsx")))
    assert table.columns == ["CCTVID", "XCOORD", "YCOORD"] and table.count() == 2
    got = cameras.read_table(table, (127.0, 37.0, 128.0, 38.0), "XCOORD", "YCOORD").collect()
    assert [tuple(r) for r in got] == [("cam one", "127.1", "37.4")]

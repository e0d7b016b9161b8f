import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbside.operators import evaluation, matching, sequences, smoother, tracking
from kerbside.operators.assignment import assign, assign_within
from kerbside.operators.graph import components, shortest
from kerbside.operators.lane_graph import Graph, gaps
from kerbside.operators.lane_graph import topology as lane_topology
from kerbside.plans import track_queries


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_assignment_is_the_cheapest(n, m, data):
    c = np.array(data.draw(st.lists(st.lists(st.integers(-20, 20), min_size=m, max_size=m), min_size=n, max_size=n)), float)
    got = assign(c)
    k = min(n, m)
    assert len(got) == k == len({i for i, _ in got}) == len({j for _, j in got})
    best = min(sum(c[i, j] for i, j in zip(r, q, strict=True)) for r in itertools.permutations(range(n), k) for q in itertools.combinations(range(m), k))
    assert sum(c[i, j] for i, j in got) == pytest.approx(best)


def test_gate():
    assert assign_within(np.array([[1e6, 2.0], [3.0, 1e6]])) == [(0, 1), (1, 0)] and assign_within(np.full((2, 2), np.inf)) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=12))
def test_isotonic_is_the_max_min_formula(y):
    got = matching.isotonic(np.array(y))
    want = [max(min(np.mean(y[a : b + 1]) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    assert got == pytest.approx(want, abs=1e-9) and (np.diff(got) >= -1e-9).all() and got.mean() == pytest.approx(np.mean(y), abs=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 20), min_size=3, max_size=40))
def test_progress_keeps_distance_and_order(steps):
    s = np.concatenate([[5.0], 5.0 + np.cumsum(steps)])
    got = matching.smooth_progress(s)
    assert got[0] == s[0] and got[-1] == pytest.approx(s[-1]) and (np.diff(got) >= -1e-9).all()


def test_isotonic_example():
    assert matching.isotonic(np.array([3.0, 1.0, 2.0])).tolist() == [2.0, 2.0, 2.0]


GRAPH = Graph({"a": (np.array([[0, 0], [50, 0]]), True), "b": (np.array([[50, 0], [100, 0]]), True), "c": (np.array([[50, 0], [50, 60]]), True), "d": (np.array([[0, 4], [100, 4]]), True)}, {"a": ["b", "c"]})


def test_graph():
    assert GRAPH.gap("a", "b") == 0 and GRAPH.gap("b", "a") is None and GRAPH.gap("a", "a") == 0
    assert GRAPH.route(("a", 10.0), ("a", 9.1)) == pytest.approx(0.9) and GRAPH.route(("a", 10.0), ("a", 8.9)) is None
    assert GRAPH.route(("a", 40.0), ("c", 5.0)) == pytest.approx(15.0)
    assert GRAPH.advance("a", 45.0, 10.0) == ("b", pytest.approx(5.0)) and GRAPH.advance("a", 45.0, 10.0, np.array([0.0, 1.0]))[0] == "c"
    s, d, r = GRAPH.onto("a", (20.0, 1.5))
    assert (s, d, r) == pytest.approx((20.0, 1.5, 1.5)) and GRAPH.heading("c", 3.0) == pytest.approx(90.0)
    assert GRAPH.at("a", 20.0, 1.5) == pytest.approx([20.0, 1.5])


def links_of(spark, graph=GRAPH):
    rows = [(k, [(float(x), float(y)) for x, y in graph.points[k][[0, -1]]], graph.directed[k]) for k in graph.ids]
    edges = [(a, b) for a in graph.ids for b in graph.successors[a]] or [("-", "-")]
    return spark.createDataFrame(rows, "link_id string, pts array<struct<x:double,y:double>>, directed boolean"), spark.createDataFrame(edges, "src string, dst string")


def drive(spark, points, heading=0.0, speed=20.0, track="t"):
    return spark.createDataFrame([(track, k, float(x), float(y), heading, speed) for k, (x, y) in enumerate(points)], "track string, frame long, x double, y double, heading double, speed_kmh double")


def matched(spark, rows, method, graph=GRAPH):
    links, edges = links_of(spark, graph)
    return matching.match_tracks(rows, links, ["track"], method, edges=edges).orderBy("track", "frame").collect()


def test_matching_keeps_to_the_road(spark):
    x = np.arange(3.0, 98.0, 4.0)
    rows = drive(spark, np.column_stack([x, np.where(np.arange(len(x)) % 5 == 2, 2.4, 0.3)]))  # now and then nearer the lane beside
    assert "d" in [r.link_id for r in matched(spark, rows, "greedy")]
    assert [r.link_id for r in matched(spark, rows, "viterbi")] == ["a" if v < 50 else "b" for v in x]
    locked = matched(spark, rows, "lock")
    along = [r.s + (50.0 if r.link_id == "b" else 0.0) for r in locked]
    assert (np.diff(along) >= 0).all() and max(abs(r.d) for r in locked) < 2.5 and along[-1] == pytest.approx(x[-1], abs=1.0)


def test_viterbi_begins_anew_where_no_route_leads(spark):
    rows = drive(spark, [(10.0, 0.0), (20.0, 0.0), (10.0, 4.0), (900.0, 900.0)], heading=None, speed=None).unionByName(drive(spark, [(500.0, 500.0)], track="far"))
    out = matched(spark, rows, "viterbi")
    assert [r.link_id is None for r in out] == [True, False, False, False, True] and out[1].link_id == "a"


def plain_viterbi(graph, rows, sigma=2.0, beta=4.0):
    """Loops over all options of all rows."""
    moving = [r.heading is not None and (r.speed_kmh or 0) >= 5 for r in rows]
    mean = sum((np.exp(1j * np.radians(r.heading)) for r, m in zip(rows, moving) if m), 0j)
    best, path, last = {}, [None] * len(rows), None
    trail = []
    for i, r in enumerate(rows):
        options = graph.near((r.x, r.y))
        if not options:
            continue
        unit = np.exp(1j * np.radians(r.heading)) if moving[i] else mean / abs(mean) if abs(mean) > 1e-9 else None
        score = []
        for link, s, d, _ in options:
            t = graph.tangent(link, s)
            c = None if unit is None else t[0] * unit.real + t[1] * unit.imag
            wrong = 0.0 if c is None else (1 - c) / 2 if graph.directed[link] else (1 - abs(c)) / 2
            score.append(-0.5 * (d / sigma) ** 2 - np.log(np.sqrt(2 * np.pi) * sigma) - 2.0 * wrong)
        back = [None] * len(options)
        if trail:
            j, old, before, _ = trail[-1]
            straight = np.hypot(r.x - rows[j].x, r.y - rows[j].y)
            move = [max(((before[a] - abs(straight - w) / beta - np.log(beta), -a) for a, o in enumerate(old) if before[a] > -np.inf and (w := graph.route(o[:2], n[:2])) is not None), default=None) for n in options]
            if any(m is not None for m in move):
                back = [None if m is None else -m[1] for m in move]
                score = [-np.inf if m is None else e + m[0] for e, m in zip(score, move)]
        trail.append((i, options, score, back))
    pick = None
    for i, options, score, back in reversed(trail):
        pick = int(np.argmax(score)) if pick is None else pick
        path[i] = options[pick][:3]
        pick = back[pick]
    return path


def test_matching_equals_plain_versions_on_a_map_with_junctions(spark):
    from kerbside.plans import tables

    sf = "/root/testdata/sf0.001"
    links = tables.roads(spark, sf)
    edges = lane_topology(links)
    graph = Graph.from_rows(links.collect(), edges.collect())
    assert any(len(v) > 1 for v in graph.successors.values()) and not all(graph.directed.values())
    rows = tables.drives(spark, sf)
    got = {(r.track_id, r.frame): r for r in matching.match_tracks(rows, links, ["track_id"], "viterbi").collect()}
    locked = {(r.track_id, r.frame): r for r in matching.match_tracks(rows, links, ["track_id"], "lock").collect()}
    tracks = {}
    for r in sorted(rows.collect(), key=lambda r: (r.track_id, r.frame)):
        tracks.setdefault(r.track_id, []).append(r)
    assert len(got) == len(locked) == sum(map(len, tracks.values()))
    same = 0
    for t, track in tracks.items():
        want = plain_viterbi(graph, track)
        mine = [got[t, r.frame] for r in track]
        for w, g in zip(want, mine, strict=True):
            assert (w is None) == (g.link_id is None)
            same += w is None or (w[0] == g.link_id and (w[1], w[2]) == pytest.approx((g.s, g.d), abs=1e-6))
        lock = [locked[t, r.frame] for r in track]
        chain = list(dict.fromkeys(x.link_id for x in lock if x.link_id))
        assert set(chain) <= {x.link_id for x in mine} and all(graph.gap(a, b) is not None for a, b in zip(chain, chain[1:]))
        assert all(0.0 <= x.s <= graph.length(x.link_id) + 1e-9 for x in lock if x.link_id)
    assert same >= 0.99 * len(got)  # equal likelihoods may be decided by the last bit


def test_matching_on_a_large_map(spark):
    """1,600 links: each row meets the links near it only."""
    n = 28
    rows = [(f"e{i}-{j}", [(i * 50.0, j * 50.0), (i * 50.0 + 50.0, j * 50.0)], True) for i in range(n) for j in range(n + 1)] + [(f"n{i}-{j}", [(i * 50.0, j * 50.0), (i * 50.0, j * 50.0 + 50.0)], True) for i in range(n + 1) for j in range(n)]
    links = spark.createDataFrame(rows, "link_id string, pts array<struct<x:double,y:double>>, directed boolean")
    points = [(k * 10.0 + 3, 500.4) for k in range(60)] + [(600.3, 500.0 + k * 10.0) for k in range(1, 60)]
    rows = drive(spark, points, heading=None, speed=None)
    out = matching.match_tracks(rows, links, ["track"], "lock").orderBy("frame").collect()
    assert [r.link_id[0] for r in out] == ["e"] * 60 + ["n"] * 59 and [r.link_id for r in out][0] == "e0-10" and out[-1].link_id == "n12-21"


def test_progress_keeps_its_width_on_short_tracks():
    s = np.array([0.0, 1.0, 1.0, 5.0])
    step = np.array([1.0, 0.0, 4.0])
    mean = np.convolve(np.pad(step, 4, mode="edge"), np.full(9, 1 / 9), "valid")
    assert matching.smooth_progress(s, 9) == pytest.approx(np.concatenate([[0.0], np.cumsum(mean * 5.0 / mean.sum())]))
    assert matching.smooth_progress(np.array([2.0, 2.0, 2.0])).tolist() == [2.0, 2.0, 2.0]


def test_smoother_gate_and_heading():
    s = smoother.Smoother()
    assert s.update(0, 0, 0.0) == (None, None)
    for k in range(1, 12):
        speed, heading = s.update(k * 1.0, 0.0, 0.1)
    assert speed == pytest.approx(36.0, rel=0.05) and heading == pytest.approx(0.0, abs=1.0)
    assert s.update(500.0, 0.0, 0.1) == (speed, heading)  # an impossible jump changes nothing
    guided = s.update(12.0, 0.0, 0.1, guide=10.0)[1]
    assert guided == pytest.approx(3.0, abs=0.5)


def test_smoother_rows_do_not_mix(spark):
    rows = spark.createDataFrame([(t, f, float(f * (1 + t)), 0.0) for t in range(3) for f in range(20)], "track_id long, frame long, x double, y double")
    out = smoother.smooth(rows, ["track_id"], 10.0).where("frame = 19").collect()
    assert sorted(round(r.speed_kmh / 36) for r in out) == [1, 2, 3]


def simulated(spark, seed=0):
    truth, found = tracking.simulate(seed)
    return truth, spark.createDataFrame(found)


def test_tracker_follows_objects(spark):
    truth, found = simulated(spark)
    out = tracking.track(found, 30.0).toPandas()
    assert len(out) == found.count()
    strong = out[out.track_id.notna()]
    nearest = strong.merge(truth, on="frame", suffixes=("", "_t")).assign(d=lambda r: np.hypot(r.x - r.x_t, r.y - r.y_t)).sort_values("d").groupby(["frame", "x", "y"]).first().reset_index()
    nearest = nearest[nearest.d < 1.5]
    share = nearest.groupby("track_id_t").track_id.agg(lambda s: s.value_counts().iloc[0] / len(s))
    assert share.mean() > 0.8 and nearest.track_id.nunique() <= 12


@pytest.mark.parametrize("name,table,most", [("ground_tracker", "events", 5), ("overlap_tracker", "lineitem", 7)])
def test_tracker_queries_track_every_detection(spark, name, table, most):
    """No detection is merged with another, and no two of a camera's frame have one track."""
    out = track_queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    held = out.groupby(["cctv_id", "frame"]).size()
    assert 1 < held.max() <= most
    tracked = out[out.track_id.notna()]
    assert not tracked.duplicated(["cctv_id", "frame", "track_id"]).any()
    assert tracked.groupby(["cctv_id", "track_id"]).size().max() > 1 and tracked.groupby(["cctv_id", "frame"]).size().max() > 1


def test_tracker_expires_and_confirms():
    t = tracking.Tracker(0.1, tracking.Settings(max_age=2))
    d = lambda x, c=0.9: {"z": np.array([x, 0.0]), "r": np.eye(2) * 0.25, "confidence": c, "class": "car"}
    assert t.step(0, [d(0.0)]) == [1] and t.step(1, [d(0.5), d(0.9, 0.05)]) == [1, None]
    t.step(2, [])
    t.step(3, [])
    t.step(4, [])
    assert t.tracks == [] and t.step(5, [d(1.0)]) == [2]


def test_cutting_at_long_gaps_changes_nothing(spark):
    truth, found = simulated(spark, 3)
    pdf = found.toPandas()
    late = pdf.assign(frame=pdf.frame + 1000)
    both = tracking.track(spark.createDataFrame(pd.concat([pdf, late])), 30.0).toPandas()
    one = tracking.track(found, 30.0).toPandas()
    a = both[both.frame < 1000].sort_values(["frame", "x"]).track_id.tolist()
    assert a == one.sort_values(["frame", "x"]).track_id.tolist()


def test_components_and_shortest_paths(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (9, 9), (None, 4)], "a long, b long")
    assert {(r.id, r.component) for r in components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components(chain).collect()} == {0}
    p = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "a", 1.0)], "src string, dst string, cost double")
    got = {(r.src, r.dst): r.cost for r in shortest(p, 10.0).collect()}
    assert got["a", "c"] == 2.0 and got["b", "a"] == 2.0
    line = spark.createDataFrame([(k, k + 1, 2.0) for k in range(200)] + [(5, 5, 0.0), (7, None, 1.0)], "src long, dst long, cost double")
    assert {(r.src, r.dst): r.cost for r in shortest(line, 300.0).collect()} == {(a, b): 2.0 * (b - a) for a in range(201) for b in range(a + 1, min(200, a + 150) + 1)}
    with pytest.raises(ValueError):
        shortest(spark.createDataFrame([("a", "b", -1.0)], "src string, dst string, cost double"), 10.0)


def test_gaps_equal_the_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    lengths = spark.createDataFrame([(k, GRAPH.length(k)) for k in GRAPH.ids], "link_id string, length double")
    got = {(r.src, r.dst): r.gap for r in gaps(edges, lengths).collect()}
    for x in GRAPH.ids:
        for y in GRAPH.ids:
            assert got.get((x, y)) == GRAPH.gap(x, y)


def boxes(spark, rows):
    return spark.createDataFrame(rows, "frame long, track_id long, x1 double, y1 double, x2 double, y2 double")


def test_a_perfect_prediction(spark):
    truth = boxes(spark, [(f, t, 100.0 * t + f, 10.0, 100.0 * t + f + 40, 60.0) for f in range(10) for t in range(3)])
    found = truth.select("frame", (F.col("track_id") + 50).alias("tracked_id"), F.lit(0.9).alias("confidence"), "x1", "y1", "x2", "y2")
    d, m = evaluation.detection_metrics(truth, found), evaluation.tracking_metrics(truth, found)
    assert d["ap"] == pytest.approx(1.0) and d["f1"] == 1.0 and m["mota"] == 1.0 and m["idf1"] == 1.0 and m["switches"] == 0 and m["mostly_tracked"] == 3


def test_metrics_of_a_bad_one(spark):
    truth = boxes(spark, [(f, 1, 0.0, 0.0, 10.0, 10.0) for f in range(10)])
    rows = [(f, 7 if f < 5 else 8, 0.5, 0.0, 0.0, 10.0, 10.0) for f in range(8)] + [(3, 9, 0.9, 50.0, 50.0, 60.0, 60.0), (99, 1, 0.9, 0.0, 0.0, 10.0, 10.0)]
    found = spark.createDataFrame(rows, "frame long, tracked_id long, confidence double, x1 double, y1 double, x2 double, y2 double")
    m = evaluation.tracking_metrics(truth, found)
    assert (m["fp"], m["fn"], m["switches"]) == (1, 2, 1) and m["mota"] == pytest.approx(1 - 4 / 10) and m["idf1"] == pytest.approx(2 * 5 / (10 + 9))
    d = evaluation.detection_metrics(truth, found)
    assert d["recall"] == 0.8 and d["precision"] == pytest.approx(8 / 9)


@pytest.mark.parametrize("ids,want", [([None, 5], 1), ([5, None], 0), ([5, None, 5], 1), ([5, 5, 6], 1), ([None, None], 0)])
def test_switches(spark, ids, want):
    m = spark.createDataFrame([(1, k, i) for k, i in enumerate(ids)], "track_id long, frame long, tracked_id long")
    assert evaluation.switches(m).first().switches == want


def test_heading_fill_and_moving_average(spark):
    rows = spark.createDataFrame([(1, k, 0.3 * k, 0.0, None) for k in range(6)], "track_id long, frame long, x double, y double, heading double")
    assert {round(r.heading, 6) for r in sequences.headings(rows, ["track_id"], ["frame"]).collect()} == {0.0}
    m = rows.select("frame", sequences.moving_average("x", ["track_id"], ["frame"], 2).alias("m")).orderBy("frame").collect()
    assert m[0].m == pytest.approx((0 + 0 + 0 + 0.3 + 0.6) / 5)


def test_snap_turns_wrong_way_tracks(spark):
    rows = spark.createDataFrame([("t", f"r{k}", 10.0 * k, 1.6, 180.0, 30.0) for k in range(5)], "track_id string, row_id string, x double, y double, heading double, speed_kmh double")
    links = spark.createDataFrame([("a", [(0.0, 0.0), (60.0, 0.0)], True)], "link_id string, pts array<struct<x:double,y:double>>, directed boolean")
    out = matching.snap(rows, links, ["track_id"], lane_width=3.5).collect()
    assert all(r.wrong_way and r.lane_offset_m == 1.75 and r.snap_y == pytest.approx(1.75) and r.snap_heading == -180.0 for r in out)
    assert matching.choose_source({"hd": (False, 90.0), "osm": (True, 60.0)}, ["hd", "osm"]) == "osm"

"""Tracks longer than a task give what one task gives."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbside.operators import lane_graph, long_tracks, matching
from kerbside.operators.long_tracks import NONE, backward, carried, forward, passage, pooled, pools
from kerbside.plans import tables

SF = "/root/testdata/sf0.001"


def random_steps(seed, n=40, k=3, lost=0.7):
    rng = np.random.default_rng(seed)
    emit = rng.integers(-9, 0, (n, k))
    emit[:, 1:][rng.random((n, k - 1)) < 0.3] = NONE
    move = rng.integers(-9, 0, (n - 1, k, k))
    move[rng.random(move.shape) < lost] = NONE
    return emit, move


@pytest.mark.parametrize("seed", range(40))
def test_stretches_give_the_path_of_the_whole(seed):
    """Ways get lost now and then, in the middle of stretches and at their ends; scores tie often."""
    emit, move = random_steps(seed, lost=0.5 + 0.4 * (seed % 5) / 4)
    scores, back = forward(emit[0], emit, move)
    want = backward(scores, back, int(np.argmax(scores[-1])))
    for size in (1, 3, 7, 39):
        entry, stretches = forward(emit[0], emit[:size], move[: size - 1])[0][-1], []
        for a in range(size - 1, len(emit) - 1, size):
            e, m = emit[a : a + size + 1], move[a : a + size]
            stretches.append((entry, e, m))
            entry = carried(entry, *passage(e, m))
        at, path = int(np.argmax(entry)), []
        for start, e, m in reversed(stretches):
            part = backward(*forward(start, e, m), at)
            path, at = [*part[1:].tolist(), *path], int(part[0])
        path = [*backward(*forward(emit[0], emit[:size], move[: size - 1]), at).tolist(), *path]
        assert path == want.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.integers(1, 9))
def test_pools_of_pools(y, size):
    """Pools of the stretches, pooled again, are the pools of the whole; those within the bounds of the other stretches stay."""
    parts = [pools(np.array(y[a : a + size], float)) for a in range(0, len(y), size)]
    level, n = pooled(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    want = np.repeat(*pools(np.array(y, float)))
    assert np.repeat(level, n) == pytest.approx(want)
    at = 0
    for k, (lv, m) in enumerate(parts):
        before = max((p[0][-1] for p in parts[:k]), default=-np.inf)
        behind = min((p[0][0] for p in parts[k + 1 :]), default=np.inf)
        for v, i in zip(lv, m, strict=True):
            if before <= v <= behind:
                assert want[at : at + i] == pytest.approx(np.full(i, v))
            at += i


def rows_of(df, *columns):
    return sorted(tuple(None if c is None else round(c, 6) if isinstance(c, float) else c for c in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("method", ["viterbi", "lock"])
def test_matching_in_stretches_equals_one_task(spark, method):
    rows, links = tables.drives(spark, SF), tables.roads(spark, SF)
    # some rows off the map, one track without any link, one without an id
    rows = rows.withColumn("x", F.when(F.col("event_id") % 11 == 0, F.lit(9e5)).when(F.col("track_id") == 3, F.lit(8e5)).otherwise(F.col("x")))
    rows = rows.withColumn("track_id", F.when(F.col("track_id") != 5, F.col("track_id"))).where("track_id is not null or event_id % 3 = 0")
    columns = ("event_id", "link_id", "s", "d")
    whole = rows_of(matching.match_tracks(rows, links, ["track_id"], method, chunk=None), *columns)
    assert rows_of(matching.match_tracks(rows, links, ["track_id"], method, chunk=4), *columns) == whole
    assert sum(r[1] is not None for r in whole) > 100


@pytest.mark.parametrize("chunk", [3, 10])
def test_monotone_and_progress_in_stretches(spark, chunk):
    rng = np.random.default_rng(chunk)
    rows = []
    for t, n in enumerate((1, 2, 40, 41, 90)):
        shape = np.cumsum(rng.normal(0.3, 2.0, n)) if t % 2 else -np.arange(n, dtype=float) if t == 2 else rng.normal(0, 1, n) + np.arange(n) * 3.0
        rows += [(None if t == 3 else t, int(f), float(v)) for f, v in zip(np.sort(rng.choice(200, n, replace=False)), shape, strict=True)]
    df = spark.createDataFrame(rows, "t long, f long, v double")
    for of in (lambda d, c: matching.monotone(d, ["t"], "f", "v", chunk=c), lambda d, c: matching.progress(d, ["t"], "f", "v", 5, chunk=c), lambda d, c: matching.progress(d, ["t"], "f", "v", 4, chunk=c)):
        one, many = ({(r.t, r.f): r.v for r in of(df, c).collect()} for c in (None, chunk))
        assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], abs=1e-9) for k in one)


def test_a_long_link_is_no_end(spark):
    """The limit is one of the gap: on links of 400 m the next one is reached from the start of the first."""
    links = spark.createDataFrame([("a", [(0.0, 0.0), (400.0, 0.0)], True), ("b", [(400.0, 0.0), (800.0, 0.0)], True)], "link_id string, pts array<struct<x:double,y:double>>, directed boolean")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    lengths = lane_graph.ends(links).select("link_id", "length")
    pairs = spark.createDataFrame([("a", 50.0, "b", 10.0), ("b", 10.0, "a", 50.0)], "link_a string, s_a double, link_b string, s_b double")
    got = {r.link_a: r.route for r in lane_graph.route_distance(pairs, lane_graph.gaps(edges, lengths), lengths).collect()}
    assert got == {"a": pytest.approx(360.0), "b": None}
    graph = lane_graph.Graph({"a": (np.array([[0, 0], [400, 0]]), True), "b": (np.array([[400, 0], [800, 0]]), True)}, {"a": ["b"]})
    assert graph.route(("a", 50.0), ("b", 10.0)) == pytest.approx(360.0) and graph.route(("b", 10.0), ("a", 50.0)) is None
    rows = spark.createDataFrame([("t", 0, 20.0, 0.5, 0.0, 50.0), ("t", 1, 420.0, 0.5, 0.0, 50.0)], "track string, frame long, x double, y double, heading double, speed_kmh double")
    assert [r.link_id for r in matching.match_tracks(rows, links, ["track"], "viterbi", edges=edges).orderBy("frame").collect()] == ["a", "b"]
    assert long_tracks.NONE + long_tracks.NONE >= np.iinfo(np.int64).min


def test_many_paths_at_once_are_those_of_each():
    """Paths of different lengths side by side have the scores, ways back and passages that each has alone."""
    paths = [random_steps(seed, n=1 + seed % 9, lost=0.8) for seed in range(60)]
    size = np.array([len(e) for e, _ in paths])
    first = np.cumsum(size) - size
    emit = np.concatenate([e for e, _ in paths])
    move = np.concatenate([np.concatenate([np.zeros((1, 3, 3), np.int64), m]) for _, m in paths])
    scores, back = long_tracks.forwards(emit[first], emit, move, first, size)
    ways = long_tracks.backwards(scores, back, np.arange(3)[None].repeat(len(size), axis=0), first, size)
    state, dies = long_tracks.passages(emit, move, first, size)
    for i, (e, m) in enumerate(paths):
        here = slice(first[i], first[i] + size[i])
        one = forward(e[0], e, m)
        assert (scores[here] == one[0]).all() and (back[here] == one[1]).all()
        assert all((ways[here, j] == backward(*one, j)).all() for j in range(3))
        through, gone, anew = passage(e, m)
        assert (dies[i] == gone).all() and (state[i] == np.where(gone[:, None] < 0, through, anew)).all()


@pytest.mark.parametrize("method", ["viterbi", "lock"])
def test_small_stretches_cost_no_call_each(spark, monkeypatch, method):
    """No step of matching in stretches calls Python for each stretch or track."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(matching, "cut", seen)
    monkeypatch.setattr(long_tracks, "cut", seen)
    links = spark.createDataFrame([("a", [(0.0, 0.0), (400.0, 0.0)], True), ("b", [(400.0, 0.0), (800.0, 0.0)], True)], "link_id string, pts array<struct<x:double,y:double>>, directed boolean")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    rows = spark.createDataFrame([(t, f, 20.0 + 60.0 * f, 0.5, 0.0, 50.0) for t in range(3) for f in range(12)], "track long, frame long, x double, y double, heading double, speed_kmh double")
    got = matching.match_tracks(rows, links, ["track"], method, edges=edges, chunk=4).collect()
    assert sorted((r.track, r.frame) for r in got if r.link_id == "b") == [(t, f) for t in range(3) for f in range(7, 12)]
    assert any("MapInArrow" in p for p in plans) and not any("FlatMapGroups" in p or "FlatMapCoGroups" in p for p in plans)


def test_rows_of_stretches_are_dealt_few_times(spark, monkeypatch):
    """Rows go through Python by stretches as often as the method needs: summaries, paths and picks, then chain, progress and links."""
    passes = []

    def counted(real):
        def run(*args):
            # by stretches and in order: of a table of rows, not of stretches
            passes.append(any(a == ["track", "_chunk"] for a in args) and any(isinstance(a, list) and "frame" in a for a in args))
            return real(*args)

        return run

    groups, pairs = counted(matching.whole_groups), counted(matching.whole_pairs)
    for module in (matching, long_tracks):
        monkeypatch.setattr(module, "whole_groups", groups)
        monkeypatch.setattr(module, "whole_pairs", pairs)
        monkeypatch.setattr(module, "cut", lambda df: df.localCheckpoint())
    links = spark.createDataFrame([("a", [(0.0, 0.0), (400.0, 0.0)], True), ("b", [(400.0, 0.0), (800.0, 0.0)], True)], "link_id string, pts array<struct<x:double,y:double>>, directed boolean")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    rows = spark.createDataFrame([(t, f, 20.0 + 60.0 * f, 0.5, 0.0, 50.0) for t in range(3) for f in range(12)], "track long, frame long, x double, y double, heading double, speed_kmh double")
    matching.match_tracks(rows, links, ["track"], "lock", edges=edges, chunk=4)
    assert sum(passes) == 6

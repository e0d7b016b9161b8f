"""Many cameras at once are tracked as each of them alone."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbside.operators import fleet, tracking
from kerbside.operators.assignment import assign, assign_groups, assign_many
from kerbside.operators.lane_graph import Graph


@pytest.mark.parametrize("seed", range(8))
def test_assignments_at_once(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(0, 6, 40)
    m = rng.integers(0, 6, 40)
    costs = [np.where(rng.random((a, b)) < 0.5, rng.integers(0, 5, (a, b)) * 1.0, 1e6) for a, b in zip(n, m, strict=True)]
    rows, columns = assign_groups(n, m, np.concatenate([c.ravel() for c in costs]))
    want, first = set(), np.zeros(2, int)
    for c, a, b in zip(costs, n, m, strict=True):
        want |= {(first[0] + i, first[1] + j) for i, j in assign(c) if c[i, j] < 1e6}
        first += a, b
    assert set(zip(rows.tolist(), columns.tolist(), strict=True)) == want
    grid = np.stack([rng.integers(0, 4, (3, 5)) * 1.0 for _ in range(20)])
    owner = assign_many(grid, np.full(20, 3), np.full(20, 5))
    for c, o in zip(grid, owner, strict=True):
        assert sorted((int(o[j]), j) for j in range(5) if o[j] >= 0) == assign(c)


@pytest.mark.parametrize("lanes", [False, True])
def test_cameras_at_once_equal_each_alone(lanes):
    graph = Graph({"a": (np.array([[-100.0, 0.0], [20.0, 0.0]]), True), "b": (np.array([[20.0, 0.0], [90.0, 30.0]]), True), "c": (np.array([[20.0, 0.0], [90.0, -30.0]]), False), "d": (np.array([[-100.0, 3.5], [120.0, 3.5]]), True)}, {"a": ["b", "c"], "c": ["a"]}) if lanes else None
    settings = tracking.Settings(max_age=6)
    cameras = [tracking.simulate(seed, frames=60, fps=10.0, lanes=1 + seed % 3, vehicles=1 + seed % 4, dropout=0.4)[1].assign(c=seed) for seed in range(6)]
    rows = pd.concat(cameras).sort_values(["c", "frame", "x", "y"], kind="stable").reset_index(drop=True)
    want = []
    for _, camera in rows.groupby("c"):
        tracker = tracking.Tracker(0.1, settings, graph)
        for frame, now in camera.groupby("frame"):
            want += tracker.step(int(frame), tracking._detections(now, settings.noise))
    n = len(rows)
    columns = {"frame": rows.frame.to_numpy(), "z": rows[["x", "y"]].to_numpy(), "confidence": rows.confidence.to_numpy(), "known": np.zeros(n, bool), "r": np.broadcast_to(np.eye(2) * settings.noise, (n, 2, 2)), "kind": np.zeros(n, int)}
    got = fleet.track_groups(rows.c.to_numpy(), columns, 0.1, settings, fleet.Lanes(graph, settings.lane_limit) if lanes else None, tracking.GATE)
    assert got.tolist() == [i or 0 for i in want] and len(set(want)) > 5


def test_many_cameras_cost_no_call_each(spark):
    """Thousands of small cameras are tracked in few calls, not frame by frame."""
    rows = spark.range(60_000).select(F.concat(F.lit("cam"), F.col("id") % 3000).alias("cctv_id"), F.floor(F.col("id") / 6000).alias("frame"), (F.col("id") % 6000 * 1.0 + F.floor(F.col("id") / 6000)).alias("x"), F.lit(0.0).alias("y"), F.lit(0.9).alias("confidence"), F.lit("car").alias("class"))
    began = time.time()
    out = tracking.track(rows, 10.0).toPandas()
    assert time.time() - began < 20 and len(out) == 60_000
    assert set(out.groupby("cctv_id").track_id.nunique()) == {2}

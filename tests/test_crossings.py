"""Crossings of many segments are those of each pair by itself, made by many tasks in small groups."""

import itertools
import math

import numpy as np
import pytest

from kerbside.operators import calibrate
from kerbside.plans import operator_queries

KIND = "seg_id long, ax double, ay double, bx double, by double"


def each_pair(rows):
    """By the rule, pair by pair."""
    out = {}
    for (a, *p), (b, *q) in itertools.permutations(rows, 2):
        if a is None or b is None or not a < b or not all(v is not None and math.isfinite(v) for v in (*p, *q)):
            continue
        ux, uy, vx, vy = p[2] - p[0], p[3] - p[1], q[2] - q[0], q[3] - q[1]
        det = ux * vy - uy * vx
        if det == 0.0 or math.hypot((p[0] + p[2] - q[0] - q[2]) / 2, (p[1] + p[3] - q[1] - q[3]) / 2) > 12.0:
            continue
        t, s = ((q[0] - p[0]) * vy - (q[1] - p[1]) * vx) / det, ((q[0] - p[0]) * uy - (q[1] - p[1]) * ux) / det
        sine = abs(det) / (math.hypot(ux, uy) * math.hypot(vx, vy))
        if 0.02 <= t <= 0.98 and 0.02 <= s <= 0.98 and math.degrees(math.asin(min(1.0, sine))) >= 30:
            out.setdefault((a, b), []).append((p[0] + t * ux, p[1] + t * uy))
    return out


def same(got, want):
    assert sorted((r.a, r.b) for r in got) == sorted(k for k, v in want.items() for _ in v) and want
    for r in got:
        assert any((r.x, r.y) == pytest.approx(p, abs=1e-9) for p in want[r.a, r.b])


@pytest.mark.parametrize("shift", [0.0, -3.0, 4_500_000.0])
@pytest.mark.parametrize("members", [5000, 3])
def test_as_pair_by_pair(spark, monkeypatch, shift, members):
    """Short and long, upright, level and slanted ones, on and off the cells' borders; full cells in one group or many."""
    monkeypatch.setattr(calibrate, "MEMBERS", members)
    rng = np.random.default_rng(11)
    rows = []
    for k in range(160):
        x, y = rng.uniform(0, 25, 2) if k % 2 else rng.integers(0, 50, 2) / 2.0
        length, turn = [0.3, 3.0, 8.0, 400.0][k % 4], rng.uniform(0, 2 * np.pi) if k % 3 else rng.integers(0, 8) * np.pi / 4
        dx, dy = (float(np.round(v, 12)) for v in (length * np.cos(turn), length * np.sin(turn)))
        rows.append((k, *(float(v) + shift for v in (x - dx / 2, y - dy / 2, x + dx / 2, y + dy / 2))))
    same(calibrate.crossings(spark.createDataFrame(rows, KIND)).collect(), each_pair(rows))


def test_odd_rows(spark, monkeypatch):
    """Rows of one id don't cross each other, but each crosses others; points, nulls and what isn't finite cross nothing."""
    monkeypatch.setattr(calibrate, "MEMBERS", 2)
    rows = [(1, 0.0, 0.0, 4.0, 4.0), (1, 0.0, 4.0, 4.0, 0.0), (2, 0.0, 3.0, 4.0, 1.0), (2, 2.1, 0.0, 2.1, 4.0), (3, 2.0, 2.0, 2.0, 2.0), (4, float("nan"), 0.0, 4.0, 4.0), (5, 0.0, float("inf"), 4.0, 4.0), (6, None, 0.0, 4.0, 4.0), (None, 0.0, 2.0, 4.0, 2.2)]
    same(calibrate.crossings(spark.createDataFrame(rows, KIND)).collect(), each_pair(rows))
    assert calibrate.crossings(spark.createDataFrame(rows[4:], KIND)).collect() == [] and calibrate.crossings(spark.createDataFrame([], KIND)).collect() == []
    named = [(f"s{k}" if k is not None else None, *p) for k, *p in rows]
    same(calibrate.crossings(spark.createDataFrame(named, KIND.replace("long", "string"))).collect(), each_pair(named))


def test_all_tasks_make_pairs(spark):
    """Pairs aren't made by the tasks that read the segments, of which a small file has one."""
    df = operator_queries.QUERIES["segment_crossings"](spark, "/root/testdata/sf0.001")
    df.collect()
    assert df.rdd.getNumPartitions() == 4

"""Work on near points follows the results, where points are many and close together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import calibrate, spatial_join


@pytest.fixture
def formed(monkeypatch):
    """The reaches that points are joined within."""
    reaches, plain = [], spatial_join.within_distance

    def told(left, right, distance, **more):
        reaches.append((left.count(), right.count(), distance))
        return plain(left, right, distance, **more)

    monkeypatch.setattr(spatial_join, "within_distance", told)
    return reaches


def points(spark, name, n):
    return spark.range(n).select(F.col("id").alias(name), (F.pmod(F.col("id") * 37, F.lit(500)) * 1.0).alias("x"), F.lit(0.0).alias("y"))


def test_nearest_k_begins_close_by(spark, formed):
    """All rows have their k long before the distance; one far off gets what there is."""
    left, right = points(spark, "a", 500).unionByName(spark.createDataFrame([(900, 560.0, 0.0)], "a long, x double, y double")), points(spark, "b", 1500)
    got = spatial_join.nearest_k(left, right, "a", "b", 3, 300.0)
    assert max(n for n, _, reach in formed if reach > 1.0) == 1
    rows = {(r.a, r["rank"]): r.r_b for r in got.collect()}
    assert len(rows) == 501 * 3
    for r in left.limit(20).collect():
        near = sorted((abs(r.x - o.x), o.b) for o in right.collect())[:3]
        assert [rows[r.a, k + 1] for k in range(3)] == [b for _, b in near]


def test_absence_needs_few_pairs(spark, formed):
    """Rows that share a small cell with a right point aren't paired; copies of a point count once."""
    left = points(spark, "a", 500).unionByName(spark.createDataFrame([(900, 540.0, 0.0), (901, 538.5, 0.0), (902, None, 0.0)], "a long, x double, y double"))
    right = points(spark, "b", 5000)
    assert {r.a for r in spatial_join.without_neighbours(left, right, "a", 40.0).collect()} == {900, 902}
    assert formed == [(2, 500, 40.0)]


def test_leaving_out_is_one_decomposition(monkeypatch):
    """The errors are those of a fit for each point, without making them; a point that the fit hangs on has its own."""
    rng = np.random.default_rng(5)
    src = rng.uniform(0, 1000, (40, 2))
    h = np.array([[0.05, 0.002, -20.0], [0.001, -0.08, 60.0], [0.0001, 0.001, 1.0]])
    dst = calibrate.apply_homography(h, src) + rng.normal(0, 0.1, src.shape)
    want = [np.hypot(*(calibrate.apply_homography(calibrate.fit_homography(np.delete(src, i, 0), np.delete(dst, i, 0)), src[i : i + 1])[0] - dst[i])) for i in range(40)]
    fits, plain = [], calibrate.fit_homography
    monkeypatch.setattr(calibrate, "fit_homography", lambda *a: fits.append(1) or plain(*a))
    assert calibrate.leave_one_out(src, dst) == pytest.approx(want, rel=1e-6)
    assert not fits
    line = np.array([[0, 0], [1, 1], [2, 2], [3, 3], [5, 0], [9, 4.0]])
    assert calibrate.leave_one_out(line, line) is not None and fits

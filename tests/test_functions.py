import math

import pytest
from pyspark.sql import functions as F

from kerbside.functions import angles, geodesy, geometry, stats


def value(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("before,after,want", [(0, 35, "left"), (0, -35, "straight"), (0, 135, "uturn"), (0, -135, "right"), (0, -180, "uturn"), (0, 0, "straight"), (350, 10, "straight"), (None, 3, "unknown")])
def test_turns(spark, before, after, want):
    assert value(spark, angles.turn_label(F.lit(before).cast("double"), F.lit(float(after))))[0] == want


@pytest.mark.parametrize("a", [-720.5, -180.0, -179.9, 0.0, 179.9, 180.0, 359.0, 1000.25])
def test_wrap(spark, a):
    got = value(spark, angles.wrap(F.lit(a)))[0]
    assert -180 <= got < 180 and math.isclose(math.cos(math.radians(got)), math.cos(math.radians(a)), abs_tol=1e-9)


def test_wilson(spark):
    assert tuple(value(spark, *stats.wilson(F.lit(0), F.lit(0)))) == (0.0, 1.0)
    low, high = value(spark, *stats.wilson(F.lit(5), F.lit(10)))
    assert low == pytest.approx(0.236593, abs=1e-5) and high == pytest.approx(0.763407, abs=1e-5)
    assert value(spark, *stats.wilson(F.lit(0), F.lit(9)))[0] == 0.0


@pytest.mark.parametrize("lon,lat", [(127.0, 37.4), (129.0, 36.5), (131.9, 0.01), (126.2, 60.0), (129.0, 83.0)])
def test_utm_round_trip(spark, lon, lat):
    e, n = geodesy.to_utm(F.lit(lon), F.lit(lat), 52)
    back = value(spark, *geodesy.from_utm(e, n, 52))
    assert back[0] == pytest.approx(lon, abs=1e-9) and back[1] == pytest.approx(lat, abs=1e-9)


def test_utm_on_the_central_meridian(spark):
    e, n = value(spark, *geodesy.to_utm(F.lit(129.0), F.lit(45.0), 52))
    # the meridian arc to 45 degrees of WGS 84 is 4984944.378 m
    assert e == pytest.approx(500000.0, abs=1e-6) and n == pytest.approx(0.9996 * 4984944.378, abs=2e-3)


def test_mercator(spark):
    x, y = geodesy.to_mercator(F.lit(127.5), F.lit(37.25))
    assert tuple(value(spark, *geodesy.from_mercator(x, y))) == pytest.approx((127.5, 37.25))
    assert tuple(value(spark, *geodesy.tile(F.lit(0.0), F.lit(0.0), 3))) == (4, 4)


def test_parallax_is_undone(spark):
    a = geometry.apparent_to_real(F.lit(30.0), F.lit(12.0), F.lit(1.5), 1.0, 2.0, 9.0)
    assert tuple(value(spark, *geometry.real_to_apparent(*a, F.lit(1.5), 1.0, 2.0, 9.0))) == pytest.approx((30.0, 12.0))
    assert tuple(value(spark, *geometry.apparent_to_real(F.lit(3.0), F.lit(4.0), F.lit(1.5), 0.0, 0.0, 0.0))) == (3.0, 4.0)
    assert tuple(value(spark, *geometry.real_to_apparent(F.lit(3.0), F.lit(4.0), F.lit(9.005), 0.0, 0.0, 9.0))) == (3.0, 4.0)


def test_distortion_is_undone(spark):
    k, d = [800.0, 0, 640, 0, 810, 360, 0, 0, 1], [-0.2, 0.05, 0.001, -0.002, 0.0]
    u, v = geometry.undistort(k, d, F.lit(900.0), F.lit(200.0), 30)
    assert tuple(value(spark, *geometry.distort(k, d, u, v))) == pytest.approx((900.0, 200.0), abs=1e-4)


def test_matrix_inverse():
    h = [0.05, 0.002, -20.0, 0.001, -0.08, 60.0, 0.0001, 0.001, 1.0]
    assert geometry.multiply3(h, geometry.inverse3(h)) == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1], abs=1e-12)


def test_floor_box(spark):
    got = value(spark, geometry.floor_box(F.lit(1.0), F.lit(2.0), F.lit(90.0), F.lit(4.0), F.lit(2.0)))[0]
    assert [c for p in got for c in p] == pytest.approx([0, 4, 2, 4, 2, 0, 0, 0])


def test_crossing(spark):
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    hit = value(spark, geometry.crossing(p(0, 0), p(2, 2), p(0, 2), p(2, 0)))[0]
    assert (hit.x, hit.y) == pytest.approx((1, 1))
    assert value(spark, geometry.crossing(p(0, 0), p(2, 0), p(0, 1), p(2, 1)))[0] is None
    assert value(spark, geometry.crossing(p(0, 0), p(10, 1), p(0, 1), p(10, 0)))[0] is None  # too flat


def test_undistort_of_many_rows(spark):
    """Rounds on arrays: nulls stay null, NaN stays NaN, and a pixel is as before alone."""
    k, d = [800.0, 0.0, 500.0, 0.0, 820.0, 350.0, 0.0, 0.0, 1.0], [-0.2, 0.05, 0.001, -0.002, 0.01]
    rows = spark.createDataFrame([(0, 900.0, 200.0), (1, None, 3.0), (2, float("nan"), 3.0)], "i int, u double, v double")
    u, v = geometry.undistort(k, d, *geometry.distort(k, d, F.col("u"), F.col("v")), 30)
    plan = rows.select("i", u.alias("a"), v.alias("b"))
    got = sorted(plan.collect())
    assert (got[0].a, got[0].b) == (pytest.approx(900.0, abs=1e-6), pytest.approx(200.0, abs=1e-6)) and got[1].a is None and math.isnan(got[2].a)
    assert "aggregate(" not in plan._jdf.queryExecution().toString().lower()


def test_box_3d_is_compiled(spark):
    floor = geometry.floor_box(F.col("id") * 1.0 + 20.0, F.lit(25.0), F.lit(30.0), F.lit(4.0), F.lit(1.8))
    h = geometry.inverse3([0.05, 0.001, -20.0, 0.002, 0.08, 5.0, 0.0, 0.0005, 1.0])
    plan = spark.range(3).withColumn("f", floor).select(geometry.box_3d(F.col("f"), F.lit(1.5), h, 0.0, -10.0, 8.0).alias("p"))
    assert "transform(" not in plan._jdf.queryExecution().toString().lower()
    for i, r in enumerate(plan.collect()):
        assert len(r.p) == 8 and all(len(q) == 2 for q in r.p), i
    none = spark.range(1).select(geometry.box_3d(F.lit(None).cast("array<array<double>>"), F.lit(1.5), h, 0.0, -10.0, 8.0).alias("p"))
    assert none.first().p is None


def test_box_pixels_computes_a_box_once(spark):
    from kerbside import plans

    plan = plans.QUERIES["box_pixels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("cos(") <= 8 and "filter" not in plan.lower()

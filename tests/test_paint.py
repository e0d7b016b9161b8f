"""Paint and the distance to it, against loops over all pixels."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.operators import paint


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 50)), min_size=1, max_size=30), st.integers(1, 3))
def test_envelope_is_the_least_of_all_parabolas(square, stride):
    y = np.arange(len(square), dtype=float) * stride
    s = np.array([np.inf if v is None else v for v in square], float)
    got = paint._envelope(y, s)
    if not np.isfinite(s).any():
        assert np.isnan(got).all()
    else:
        assert got == pytest.approx([min((a - b) ** 2 + v for b, v in zip(y, s, strict=True)) for a in y])


def image(seed, w=17, h=13, holes=0.1):
    rng = np.random.default_rng(seed)
    g = rng.integers(1, 60, (h, w))
    g[:, 8] += 120
    g[5:7, :] += 90
    return [(seed, x, y, int(g[y, x])) for y in range(h) for x in range(w) if rng.random() >= holes]


def disc(r):
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= round(math.sqrt(r * r - dy * dy))]


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_top_hat_on_images_with_holes(spark, radius):
    rows = image(1) + image(2, holes=0.0)
    got = {(r.image, r.x, r.y): r.top_hat for r in paint.top_hat(spark.createDataFrame(rows, "image long, x int, y int, gray int"), radius).collect()}
    value = {(i, x, y): g for i, x, y, g in rows}
    near = lambda of, i, x, y: [of[i, x + dx, y + dy] for dx, dy in disc(radius) if (i, x + dx, y + dy) in of]
    low = {k: min(near(value, *k)) for k in value}
    assert got == {k: value[k] - max(near(low, *k)) for k in value}


def test_paint_and_distance(spark):
    rows = [(*r, r[1] < 15) for r in image(3)] + [(4, x, y, 0, True) for x in range(3) for y in range(3)] + [(5, 0, 0, None, True), (None, 1, 1, 9, True)]
    out = paint.paint_mask(spark.createDataFrame(rows, "image long, x int, y int, gray int, inside boolean"), radius=2, keep_pct=40.0).collect()
    mask = {(r.image, r.x, r.y): r.paint for r in out}
    assert len(mask) == len(rows) - 1 and not any(v for k, v in mask.items() if k[0] in (4, None))
    some = [k for k, v in mask.items() if v]
    assert some and all(k[1] < 15 for k in some)
    # each lies in a block of four
    assert all(any(all(mask.get((i, x + a + dx, y + b + dy)) for dx in (0, 1) for dy in (0, 1)) for a in (-1, 0) for b in (-1, 0)) for i, x, y in some)
    far = {(r.image, r.x, r.y): r.distance for r in paint.distance_field(spark.createDataFrame(out)).collect()}
    for (i, x, y), d in far.items():
        want = min((math.hypot(x - a, y - b) for k, a, b in some if k == i), default=None)
        assert d == (pytest.approx(want) if want is not None else None)


def test_empty(spark):
    none = spark.createDataFrame([], "image long, x int, y int, gray int")
    assert paint.paint_mask(none).collect() == [] and paint.distance_field(paint.paint_mask(none)).collect() == []

"""Image and ground geometry as Column functions.

A matrix is a sequence of nine columns or numbers by rows.  A camera stands at
(cx, cy) on the ground, z metres high.  Points are pairs of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[Column, Column]
Matrix = Sequence  # nine columns or numbers


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def project(h: Matrix, u: Column, v: Column) -> Point:
    """The point under a homography; null on the horizon."""
    a = [_c(x) for x in h]
    w = F.nullif(a[6] * u + a[7] * v + a[8], F.lit(0.0))
    return (a[0] * u + a[1] * v + a[2]) / w, (a[3] * u + a[4] * v + a[5]) / w


def inverse3(h: Sequence[float]) -> list[float]:
    """Inverse of a matrix of numbers."""
    a, b, c, d, e, f, g, i, j = h
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    if not det:
        raise ValueError("the matrix has no inverse")
    return [(e * j - f * i) / det, (c * i - b * j) / det, (b * f - c * e) / det, (f * g - d * j) / det, (a * j - c * g) / det, (c * d - a * f) / det, (d * i - e * g) / det, (b * g - a * i) / det, (a * e - b * d) / det]


def multiply3(p: Sequence[float], q: Sequence[float]) -> list[float]:
    """Product of two matrices of numbers."""
    return [sum(p[3 * r + k] * q[3 * k + c] for k in range(3)) for r in range(3) for c in range(3)]


def undistort(k: Sequence[float], d: Sequence[float], u: Column, v: Column, rounds: int = 8) -> Point:
    """Pixel without lens distortion (k1, k2, p1, p2, k3), by fixed-point rounds; the pixel itself where all of d is 0, null where a round divides by 0."""
    if not any(d):
        return u, v
    d = [*d, 0.0, 0.0, 0.0, 0.0, 0.0][:5]
    x0, y0 = (u - k[2]) / k[0], (v - k[5]) / k[4]

    @F.arrow_udf("struct<x:double,y:double>")
    def fixed(x0: pa.Array, y0: pa.Array) -> pa.Array:
        # on arrays: an unrolled expression would double with each round, and a fold is interpreted row by row
        none = ~(x0.is_valid().to_numpy(zero_copy_only=False) & y0.is_valid().to_numpy(zero_copy_only=False))
        u0, v0 = (np.where(none, 0.0, c.to_numpy(zero_copy_only=False)) for c in (x0, y0))
        x, y = u0, v0
        with np.errstate(all="ignore"):
            for _ in range(rounds):
                r = x * x + y * y
                radial = 1.0 + r * (d[0] + r * (d[1] + r * d[4]))
                none |= radial == 0.0
                x, y = (u0 - (2.0 * d[2] * x * y + d[3] * (r + 2.0 * x * x))) / radial, (v0 - (d[2] * (r + 2.0 * y * y) + 2.0 * d[3] * x * y)) / radial
        return pa.StructArray.from_arrays([pa.array(x, mask=none), pa.array(y, mask=none)], ["x", "y"])

    out = fixed(x0, y0)
    return out["x"] * k[0] + k[2], out["y"] * k[4] + k[5]


def distort(k: Sequence[float], d: Sequence[float], u: Column, v: Column) -> Point:
    """Pixel with lens distortion: the inverse of undistort."""
    if not any(d):
        return u, v
    d = [*d, 0.0, 0.0, 0.0, 0.0, 0.0][:5]
    x, y = (u - k[2]) / k[0], (v - k[5]) / k[4]
    r = x * x + y * y
    radial = 1.0 + r * (d[0] + r * (d[1] + r * d[4]))
    return (x * radial + 2.0 * d[2] * x * y + d[3] * (r + 2.0 * x * x)) * k[0] + k[2], (y * radial + d[2] * (r + 2.0 * y * y) + 2.0 * d[3] * x * y) * k[4] + k[5]


def apparent_to_real(x: Column, y: Column, h: Column, cx, cy, z) -> Point:
    """Ground point below something h metres high that is seen at ground point (x, y); unchanged for a camera at height 0."""
    cx, cy, z = _c(cx), _c(cy), _c(z)
    scale = F.when(z == 0.0, F.lit(1.0)).otherwise((z - h) / F.nullif(z, F.lit(0.0)))
    return cx + (x - cx) * scale, cy + (y - cy) * scale


def real_to_apparent(x: Column, y: Column, h: Column, cx, cy, z) -> Point:
    """Ground point at which something h metres high above (x, y) is seen; unchanged where it is within a centimetre of the camera's height."""
    cx, cy, z = _c(cx), _c(cy), _c(z)
    scale = F.when(F.abs(z - h) < 0.01, F.lit(1.0)).otherwise(z / F.nullif(z - h, F.lit(0.0)))
    return cx + (x - cx) * scale, cy + (y - cy) * scale


def pixel_to_ground(h: Matrix, u: Column, v: Column, height: Column, cx, cy, z) -> Point:
    """Homography, then parallax."""
    x, y = project(h, u, v)
    return apparent_to_real(x, y, height, cx, cy, z)


def ground_to_pixel(h_inverse: Matrix, x: Column, y: Column, height: Column, cx, cy, z) -> Point:
    """Parallax, then inverse homography."""
    a, b = real_to_apparent(x, y, height, cx, cy, z)
    return project(h_inverse, a, b)


def contact_point(box: tuple[Column, Column, Column, Column], height: Column, h: Matrix, cx, cy, z, reference: str = "bottom", method: str = "full") -> Point:
    """Where the object in a box touches the ground.

    reference: `bottom` (middle of the lower side) or `centre`; method: `full`
    takes the object's height off, `half` half of it, `none` nothing.
    """
    x1, y1, x2, y2 = box
    u = (x1 + x2) / 2.0
    v = y2 if reference == "bottom" else (y1 + y2) / 2.0
    if method == "none":
        return project(h, u, v)
    return pixel_to_ground(h, u, v, height / 2.0 if method == "half" else height, cx, cy, z)


def floor_box(x: Column, y: Column, heading: Column, length: Column, width: Column) -> Column:
    """array<array<double>>: front left, front right, rear right, rear left corner of a rectangle with this heading."""
    c, s = F.cos(F.radians(heading)), F.sin(F.radians(heading))
    corners = [(length / 2.0, width / 2.0), (length / 2.0, -width / 2.0), (-length / 2.0, -width / 2.0), (-length / 2.0, width / 2.0)]
    return F.array(*(F.array(x + a * c - b * s, y + a * s + b * c) for a, b in corners))


def box_3d(floor: Column, height: Column, h_inverse: Matrix, cx, cy, z) -> Column:
    """Eight pixels: the floor's corners, then those `height` above them."""

    def lift(p: Column, top: bool) -> Column:
        u, v = ground_to_pixel(h_inverse, p[0], p[1], height if top else F.lit(0.0), cx, cy, z)
        return F.array(u, v)

    # written out, as functions of arrays are interpreted row by row
    return F.when(floor.isNotNull(), F.array(*(lift(F.get(floor, F.lit(k)), top) for top in (False, True) for k in range(4))))


def with_ground_covariance(rows: DataFrame, h: Matrix, u: Column, v: Column, height: Column, cx, cy, z, sigma: float = 3.0) -> DataFrame:
    """`rows` with c_xx, c_xy, c_yy: the covariance on the ground of `sigma` pixels of noise, by finite differences of one pixel.

    In stages, so that each projection is computed once.
    """
    at = {"_0": (u, v), "_1": (u + 1.0, v), "_2": (u, v + 1.0)}
    places = {f"{c}{k}": p for k, uv in at.items() for c, p in zip("xy", pixel_to_ground(h, *uv, height, cx, cy, z), strict=True)}
    out = rows.withColumns(places)
    steps = {f"_d{c}{k}": F.col(f"{c}_{k}") - F.col(f"{c}_0") for c in "xy" for k in (1, 2)}
    out = out.withColumns(steps)
    s = sigma * sigma
    a, b, c, d = (F.col(n) for n in ("_dx1", "_dx2", "_dy1", "_dy2"))
    return out.withColumns({"c_xx": s * (a * a + b * b), "c_xy": s * (a * c + b * d), "c_yy": s * (c * c + d * d)}).drop(*places, *steps)


def largest_sigma(xx: Column, xy: Column, yy: Column) -> Column:
    """Square root of the larger eigenvalue of a symmetric 2 x 2 matrix."""
    half = (xx + yy) / 2.0
    return F.sqrt(half + F.sqrt((xx - yy) * (xx - yy) / 4.0 + xy * xy))


def smallest_sigma(xx: Column, xy: Column, yy: Column) -> Column:
    """Square root of the smaller eigenvalue."""
    half = (xx + yy) / 2.0
    return F.sqrt(F.greatest(F.lit(0.0), half - F.sqrt((xx - yy) * (xx - yy) / 4.0 + xy * xy)))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2) over their union; 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, both / F.nullif(union, F.lit(0.0))).otherwise(F.lit(0.0))


def in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Whether a point is inside a polygon, by crossings of a ray to the right."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if ay != by:
            crossing = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            crossings = crossings + crossing.cast("int")
    return crossings % 2 == 1


def on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct<t, x, y, dist, side>: nearest point of a segment; side is the signed distance from its line, left positive."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(n, F.lit(0.0))))).otherwise(F.lit(0.0))
    x, y = ax + t * dx, ay + t * dy
    side = (dx * (py - ay) - dy * (px - ax)) / F.nullif(F.sqrt(n), F.lit(0.0))
    return F.struct(t.alias("t"), x.alias("x"), y.alias("y"), F.hypot(px - x, py - y).alias("dist"), side.alias("side"))


def crossing(a1: Point, a2: Point, b1: Point, b2: Point, margin: float = 0.02, least_degrees: float = 30.0) -> Column:
    """struct<x, y>: where two segments cross, away from their ends and at enough of an angle; else null."""
    ax, ay, bx, by = a2[0] - a1[0], a2[1] - a1[1], b2[0] - b1[0], b2[1] - b1[1]
    det = F.nullif(ax * by - ay * bx, F.lit(0.0))
    t = ((b1[0] - a1[0]) * by - (b1[1] - a1[1]) * bx) / det
    s = ((b1[0] - a1[0]) * ay - (b1[1] - a1[1]) * ax) / det
    sine = F.abs(det) / F.nullif(F.hypot(ax, ay) * F.hypot(bx, by), F.lit(0.0))
    ok = t.between(margin, 1 - margin) & s.between(margin, 1 - margin) & (F.degrees(F.asin(F.least(F.lit(1.0), sine))) >= least_degrees)
    return F.when(ok, F.struct((a1[0] + t * ax).alias("x"), (a1[1] + t * ay).alias("y")))

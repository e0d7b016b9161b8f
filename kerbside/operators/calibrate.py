"""Fitting cameras to the ground: affine maps, homographies, similarities, vanishing points, poses.

Point tables have cctv_id, n, u, v (pixels) and x, y (metres).  A camera has
tens of points, so each fit is one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sequences

#: Segments of a cell that meet all others there in one group.
MEMBERS = 5000

MATRIX = ", ".join(f"h{r}{c} double" for r in range(3) for c in range(3))
_KEYS = [f"h{r}{c}" for r in range(3) for c in range(3)]


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Least squares with the last element 1, from four points or more."""
    src, dst = np.asarray(src, float), np.asarray(dst, float)
    if len(src) < 4:
        raise ValueError("four points are needed")
    a, target, scale = _equations(src, dst)
    h, *_ = np.linalg.lstsq(a / scale, target, rcond=None)
    return np.append(h / scale, 1.0).reshape(3, 3)


def _equations(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two rows for each point (those of x first) of a linear system for a homography, what they should give, and the size of its columns."""
    u, v, x, y = src[:, 0], src[:, 1], dst[:, 0], dst[:, 1]
    zero, one = np.zeros(len(u)), np.ones(len(u))
    a = np.vstack([np.column_stack([u, v, one, zero, zero, zero, -u * x, -v * x]), np.column_stack([zero, zero, zero, u, v, one, -u * y, -v * y])])
    return a, np.concatenate([x, y]), np.maximum(np.abs(a).max(0), 1e-12)


def apply_homography(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.column_stack([points, np.ones(len(points))]) @ h.T
    return p[:, :2] / p[:, 2:]


def leave_one_out(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Error of each point under the fit of all others; None for fewer than five.

    One decomposition for all: without a point's two rows the least-squares fit moves by its residuals, through
    what the rows have in common with the others.  Points that the fit hangs on are left out in full.
    """
    if len(src) < 5:
        return None
    src, dst = np.asarray(src, float), np.asarray(dst, float)

    def plain(i: int) -> float:
        keep = np.arange(len(src)) != i
        return float(np.hypot(*(apply_homography(fit_homography(src[keep], dst[keep]), src[i : i + 1])[0] - dst[i])))

    a, target, scale = _equations(src, dst)
    q, r = np.linalg.qr(a / scale)
    size = np.abs(np.diag(r))
    if size.min() <= 1e-10 * size.max():
        return np.array([plain(i) for i in range(len(src))])
    h = np.linalg.solve(r, q.T @ target)
    left = (target - a / scale @ h).reshape(2, -1).T
    rows = q.reshape(2, len(src), 8).transpose(1, 0, 2)
    free = np.eye(2) - rows @ rows.transpose(0, 2, 1)
    hangs = np.linalg.det(free) <= 1e-6
    free[hangs] = np.eye(2)
    moved = np.linalg.solve(r, np.einsum("nij,ni->jn", rows, np.linalg.solve(free, left[:, :, None])[:, :, 0]))
    fits = np.column_stack([(h[:, None] - moved).T / scale, np.ones(len(src))]).reshape(-1, 3, 3)
    p = np.einsum("nij,nj->ni", fits, np.column_stack([src, np.ones(len(src))]))
    out = np.hypot(*(p[:, :2] / p[:, 2:] - dst).T)
    for i in np.flatnonzero(hangs):
        out[i] = plain(i)
    return out


def homographies(points: DataFrame) -> DataFrame:
    """Rows (cctv_id, n_points, h00..h22): the fit of each camera with four points or more."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 4:
            return pd.DataFrame(columns=["cctv_id", "n_points", *_KEYS])
        h = fit_homography(rows[["u", "v"]].to_numpy(), rows[["x", "y"]].to_numpy())
        return pd.DataFrame([[rows.cctv_id.iloc[0], len(rows), *h.reshape(-1)]], columns=["cctv_id", "n_points", *_KEYS])

    return points.groupBy("cctv_id").applyInPandas(run, f"cctv_id string, n_points long, {MATRIX}")


def point_errors(points: DataFrame) -> DataFrame:
    """Rows (cctv_id, n, error): metres of each point when it is left out; cameras of fewer than five points have none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        e = leave_one_out(rows[["u", "v"]].to_numpy(), rows[["x", "y"]].to_numpy())
        return rows[["cctv_id", "n"]].assign(error=e) if e is not None else pd.DataFrame(columns=["cctv_id", "n", "error"])

    return points.groupBy("cctv_id").applyInPandas(run, f"cctv_id string, n {points.schema['n'].dataType.simpleString()}, error double")


def loo_rms(errors: DataFrame) -> DataFrame:
    """Root mean square of the left-out errors by camera."""
    return errors.groupBy("cctv_id").agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("loo_rms"))


def spread(points: DataFrame, height: float) -> DataFrame:
    """Rows (cctv_id, n_points, v_span, redundancy): how far the points reach over the image's height, and how many there are beyond four."""
    return points.groupBy("cctv_id").agg(F.count(F.lit(1)).alias("n_points"), ((F.max("v") - F.min("v")) / height).alias("v_span"), F.greatest(F.lit(0), F.count(F.lit(1)) - 4).alias("redundancy"))


def drop_outliers(points: DataFrame, target: float = 1.5, least: int = 6) -> DataFrame:
    """Points that stay: while the left-out error is over `target` and more than `least` remain, the one without which it is least goes, if that makes it less."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n").reset_index(drop=True)
        while len(rows) > max(least, 5):
            e = leave_one_out(rows[["u", "v"]].to_numpy(), rows[["x", "y"]].to_numpy())
            rms = float(np.sqrt((e**2).mean()))
            if rms <= target:
                break
            fewer = [rows.drop(index=i).reset_index(drop=True) for i in rows.index]
            left = [leave_one_out(f[["u", "v"]].to_numpy(), f[["x", "y"]].to_numpy()) for f in fewer]
            after = [float(np.sqrt((e**2).mean())) if e is not None else np.inf for e in left]
            if min(after) >= rms:
                break
            rows = fewer[int(np.argmin(after))]
        return rows

    return points.groupBy("cctv_id").applyInPandas(run, points.schema)


def affine_sums(points: DataFrame, by: str = "cctv_id") -> DataFrame:
    """The sums that an affine fit needs, as one row for each camera; they combine before the shuffle."""
    u, v, x, y = (F.col(c) for c in "uvxy")
    terms = {"n": F.lit(1.0), "u": u, "v": v, "uu": u * u, "uv": u * v, "vv": v * v, "x": x, "ux": u * x, "vx": v * x, "y": y, "uy": u * y, "vy": v * y}
    return points.groupBy(by).agg(*(F.sum(t).alias(k) for k, t in terms.items()))


def solve_affine(row) -> np.ndarray | None:
    """2 x 3 matrix from a row of sums; None for fewer than three points or points on a line."""
    a = np.array([[row.uu, row.uv, row.u], [row.uv, row.vv, row.v], [row.u, row.v, row.n]])
    if row.n < 3 or abs(np.linalg.det(a)) < 1e-9:
        return None
    return np.vstack([np.linalg.solve(a, [row.ux, row.vx, row.x]), np.linalg.solve(a, [row.uy, row.vy, row.y])])


def similarity(src: np.ndarray, dst: np.ndarray, scaled: bool = True) -> np.ndarray:
    """3 x 3 rotation, scale and shift of least squares without reflection; one point shifts alone, none changes nothing."""
    src, dst = np.asarray(src, float).reshape(-1, 2), np.asarray(dst, float).reshape(-1, 2)
    out = np.eye(3)
    if not len(src):
        return out
    a, b = src.mean(0), dst.mean(0)
    if len(src) > 1:
        p, q = src - a, dst - b
        dot, cross = float((p * q).sum()), float((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum())
        angle = np.arctan2(cross, dot)
        size = np.hypot(dot, cross) / max(float((p**2).sum()), 1e-12) if scaled else 1.0
        out[:2, :2] = size * np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    out[:2, 2] = b - out[:2, :2] @ a
    return out


def similarity_fits(points: DataFrame, by: str = "cctv_id") -> DataFrame:
    """Rows (by, n, a, b, c, d, e, f): for each camera the rotation, scale and shift x = a u + b v + c, y = d u + e v + f of least squares, as `similarity` fits one.

    Sums combine before the shuffle.  Points with a null don't count; points
    that all lie in one place give a shift alone.
    """
    u, v, x, y = (F.col(c) for c in "uvxy")
    terms = {"_u": u, "_v": v, "_x": x, "_y": y, "_q": u * u + v * v, "_dot": u * x + v * y, "_cross": u * y - v * x}
    known = points.where("u is not null and v is not null and x is not null and y is not null")
    s = known.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(t).alias(k) for k, t in terms.items()))
    size = F.col("_q") - (F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v")) / F.col("n")
    dot = F.col("_dot") - (F.col("_u") * F.col("_x") + F.col("_v") * F.col("_y")) / F.col("n")
    cross = F.col("_cross") - (F.col("_u") * F.col("_y") - F.col("_v") * F.col("_x")) / F.col("n")
    turned = size > 1e-9 * F.greatest(F.col("_q"), F.lit(1e-3))
    s = s.withColumns({"a": F.when(turned, dot / size).otherwise(1.0), "d": F.when(turned, cross / size).otherwise(0.0)})
    a, d, n = F.col("a"), F.col("d"), F.col("n")
    return s.select(by, "n", "a", (-d).alias("b"), ((F.col("_x") - a * F.col("_u") + d * F.col("_v")) / n).alias("c"), "d", a.alias("e"), ((F.col("_y") - d * F.col("_u") - a * F.col("_v")) / n).alias("f"))


def template_homography(width: int, height: int, pixels: list[tuple[float, float]], metres: list[tuple[float, float]]) -> np.ndarray:
    """A first guess for a new camera: four points as shares of the image, and where they are on the ground."""
    return fit_homography(np.array(pixels) * [width, height], np.array(metres))


def save(h: np.ndarray | None, pixels: np.ndarray, ground: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """(matrix, origin) after an edit of control points: four or more fit anew around their mean; fewer move the old matrix; none leaves it.

    ground is in map metres for a new fit, in the old matrix's metres else.
    """
    pixels, ground = np.asarray(pixels, float).reshape(-1, 2), np.asarray(ground, float).reshape(-1, 2)
    if len(pixels) >= 4:
        origin = ground.mean(0)
        return fit_homography(pixels, ground - origin), origin
    if h is None or not len(pixels):
        return h, np.zeros(2)
    m = similarity(apply_homography(h, pixels), ground) @ h
    return m / m[2, 2], np.zeros(2)


def vanishing_point(segments: DataFrame, by: str = "cctv_id") -> DataFrame:
    """Rows (by, vx, vy): the point nearest all lines through the segments (by, x1, y1, x2, y2), weighted by length, from five sums."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    a, b, w = -dy, dx, F.hypot(dx, dy)
    c = a * F.col("x1") + b * F.col("y1")
    s = segments.where(w > 0).groupBy(by).agg(F.sum(a * a / w).alias("aa"), F.sum(a * b / w).alias("ab"), F.sum(b * b / w).alias("bb"), F.sum(a * c / w).alias("ac"), F.sum(b * c / w).alias("bc"))
    det = F.nullif(F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab"), F.lit(0.0))
    return s.select(by, ((F.col("ac") * F.col("bb") - F.col("bc") * F.col("ab")) / det).alias("vx"), ((F.col("bc") * F.col("aa") - F.col("ac") * F.col("ab")) / det).alias("vy"))


def focal(v1: tuple[float, float], v2: tuple[float, float], width: int, height: int) -> float | None:
    """Focal length from the vanishing points of two directions at right angles; None if they don't give one."""
    square = -((v1[0] - width / 2) * (v2[0] - width / 2) + (v1[1] - height / 2) * (v2[1] - height / 2))
    return float(np.sqrt(square)) if square > 0 else None


def ground_matrix(vp: tuple[float, float], f: float, width: int, height: int, camera_height: float) -> np.ndarray:
    """Homography from pixels to ground metres (x to the right, y along the road), camera above the origin."""
    pitch = np.arctan2(height / 2 - vp[1], f)
    yaw = np.arctan2((vp[0] - width / 2) * np.cos(pitch), f)
    cp, sp, cy, sy = np.cos(pitch), np.sin(pitch), np.cos(yaw), np.sin(yaw)
    ray = np.array([[1 / f, 0, -width / 2 / f], [0, 1 / f, -height / 2 / f], [0, 0, 1.0]])
    # camera axes (right, down, forward) tipped by the pitch, then turned by the yaw
    tip = np.array([[1, 0, 0], [0, cp, sp], [0, -sp, cp]])
    level = tip @ ray
    turn = np.array([[cy, 0, -sy], [0, 1, 0], [sy, 0, cy]])
    level = turn @ level
    return np.vstack([camera_height * level[0], camera_height * level[2], level[1]])


def pose(h_ground_to_image: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, translation) of a ground-to-image homography, the rotation made orthonormal."""
    b = np.linalg.inv(k) @ h_ground_to_image
    b = b * (2.0 / (np.linalg.norm(b[:, 0]) + np.linalg.norm(b[:, 1])))
    if b[2, 2] < 0:
        b = -b
    u, _, vt = np.linalg.svd(np.column_stack([b[:, 0], b[:, 1], np.cross(b[:, 0], b[:, 1])]))
    r = u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt
    return r, b[:, 2]


def recompose(r: np.ndarray, t: np.ndarray, f: float, cx: float, cy: float) -> np.ndarray:
    """Ground-to-image homography of a pose."""
    h = np.array([[f, 0, cx], [0, f, cy], [0, 0, 1.0]]) @ np.column_stack([r[:, 0], r[:, 1], t])
    return h / h[2, 2]


def physical(r: np.ndarray, t: np.ndarray, lowest: float = 2.0, highest: float = 60.0) -> bool:
    """Whether the camera stands above the ground at a height that a mast may have."""
    return lowest <= abs(float((-r.T @ t)[2])) <= highest


def depth_positive(h: np.ndarray, points: np.ndarray) -> bool:
    """Whether all points lie in front of the camera."""
    return bool((np.column_stack([points, np.ones(len(points))]) @ h[2] > 1e-6).all())


def size_ratio(boxes: DataFrame, by: str = "cctv_id", least: int = 20, low: float = 0.7, high: float = 1.4) -> DataFrame:
    """Rows (by, n, ratio_w, ratio_h, anisotropy, ok): medians of seen over expected size of cars and vans (class, rw, rh, pw, ph); null for fewer than `least`."""
    some = boxes.where(F.lower("class").isin("car", "van") & (F.col("rw") >= 4) & (F.col("rh") >= 4))
    m = some.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile(F.col("rw") / F.col("pw"), F.lit(0.5)).alias("w"), F.percentile(F.col("rh") / F.col("ph"), F.lit(0.5)).alias("h"))
    enough = F.col("n") >= least
    w, h = F.when(enough, F.col("w")), F.when(enough, F.col("h"))
    return m.select(by, "n", w.alias("ratio_w"), h.alias("ratio_h"), (w / F.nullif(h, F.lit(0.0))).alias("anisotropy"), (w.between(low, high) & h.between(low, high)).alias("ok"))


def feasibility(boxes: DataFrame, height: float, bands: int = 6, least: int = 10, by: str = "cctv_id") -> DataFrame:
    """Rows (by, band, n, median_px, p10_px, verdict): how large objects (y, size) are in bands of the image; bands of fewer than `least` go.

    verdict: `good` from a median of 24 pixels, `hard` from 12, else `no`.
    """
    band = F.least(F.lit(bands), F.greatest(F.lit(1), F.width_bucket(F.col("y"), F.lit(0.0), F.lit(float(height)), F.lit(bands))))
    m = boxes.groupBy(by, (band - 1).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.percentile("size", F.lit(0.5)).alias("median_px"), F.percentile("size", F.lit(0.1)).alias("p10_px")).where(F.col("n") >= least)
    return m.withColumn("verdict", F.when(F.col("median_px") >= 24, "good").when(F.col("median_px") >= 12, "hard").otherwise("no"))


def corners(polygons: DataFrame, by: str = "poly_id", sharper: float = 150.0, least: float = 0.3) -> DataFrame:
    """Rows (by, n, x, y, angle): corners of closed rings (by, pts) with long enough sides and an angle below `sharper` degrees."""
    n = F.size("pts")
    each = polygons.withColumn("_n", n).select(by, "_n", "pts", F.posexplode("pts").alias("n", "p"))
    a, b = F.get("pts", F.pmod(F.col("n") - 1 + F.col("_n"), F.col("_n"))), F.get("pts", F.pmod(F.col("n") + 1, F.col("_n")))
    ax, ay, bx, by_ = a["x"] - F.col("p.x"), a["y"] - F.col("p.y"), b["x"] - F.col("p.x"), b["y"] - F.col("p.y")
    la, lb = F.hypot(ax, ay), F.hypot(bx, by_)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by_) / F.nullif(la * lb, F.lit(0.0))))))
    return each.select(by, "n", F.col("p.x").alias("x"), F.col("p.y").alias("y"), angle.alias("angle"), la.alias("la"), lb.alias("lb")).where((F.col("la") >= least) & (F.col("lb") >= least) & (F.col("angle") < sharper)).drop("la", "lb")


def spread_pick(candidates: pd.DataFrame, width: float, height: float, n: int, cells: int = 3, least_px: float = 40.0) -> pd.DataFrame:
    """Up to n candidates (u, v, score), best first in turn from the cells of a grid, none nearer another than `least_px`."""
    zone = np.clip((candidates.v / height * cells).astype(int), 0, cells - 1) * cells + np.clip((candidates.u / width * cells).astype(int), 0, cells - 1)
    queues = {z: list(g.sort_values("score", ascending=False, kind="stable").index) for z, g in candidates.groupby(zone)}
    chosen: list = []
    while len(chosen) < n and any(queues.values()):
        for z in sorted(queues):
            while queues[z] and len(chosen) < n:
                i = queues[z].pop(0)
                if all(np.hypot(candidates.u[i] - candidates.u[j], candidates.v[i] - candidates.v[j]) >= least_px for j in chosen):
                    chosen.append(i)
                    break
    return candidates.loc[chosen]


def crossings(segments: DataFrame, key: str = "seg_id", reach: float = 12.0, margin: float = 0.02, least_degrees: float = 30.0) -> DataFrame:
    """Rows (a, b, x, y): where segments (key, ax, ay, bx, by) whose middles are within `reach` cross.

    Segments meet in the small cells that they pass through, and a pair counts in the cell of its crossing alone,
    so that pairs follow the crossings, not the segments within reach.  A crossing is no farther from both middles
    than `reach` over the sine of the least angle (above 0), so long segments are cut to that.
    """
    least_sine = math.sin(math.radians(least_degrees))
    size, around = reach / 24.0, reach / least_sine
    d = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in "xy"}
    m = {c: (F.col(f"a{c}") + F.col(f"b{c}")) / 2.0 for c in "xy"}
    rows = segments.select(F.col(key).alias("k"), *(F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by"))).withColumn("_length", F.hypot(d["x"], d["y"])).where(F.col("k").isNotNull() & (F.col("_length") > 0.0) & (F.col("_length") < float("inf")))
    # u is the coordinate that a segment runs along more, v the other; slack is far above what rounding moves a crossing by
    steep = F.abs(d["y"]) > F.abs(d["x"])
    u, v, du, dv = (F.when(steep, p).otherwise(q) for p, q in ((m["y"], m["x"]), (m["x"], m["y"]), (d["y"], d["x"]), (d["x"], d["y"])))
    slack = size * 1e-6 + (F.abs(m["x"]) + F.abs(m["y"])) * 1e-12
    half = F.least(F.lit(0.5 - margin), around / F.col("_length")) * F.abs(du)
    walks = sequences.deal(rows, "k").select("k", "ax", "ay", "bx", "by", steep.alias("_steep"), u.alias("_u"), v.alias("_v"), (dv / du).alias("_slope"), slack.alias("_e"), (half + 2.0 * slack).alias("_half"))
    low, high = F.col("_u") - F.col("_half"), F.col("_u") + F.col("_half")
    walks = walks.withColumn("_cu", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    ends = [F.col("_v") + (end - F.col("_u")) * F.col("_slope") for end in (F.greatest(low, F.col("_cu") * size - F.col("_e")), F.least(high, (F.col("_cu") + 1) * size + F.col("_e")))]
    walks = walks.withColumn("_cv", F.explode(F.sequence(F.floor((F.least(*ends) - F.col("_e")) / size), F.floor((F.greatest(*ends) + F.col("_e")) / size))))
    cells = walks.select("k", "ax", "ay", "bx", "by", *(F.when(F.col("_steep"), F.col(p)).otherwise(F.col(q)).alias(c) for c, p, q in (("_cx", "_cv", "_cu"), ("_cy", "_cu", "_cv"))))
    # a full cell is many groups, each with some members that meet all others
    full = cells.groupBy("_cx", "_cy").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("_pieces")).where("_pieces > 1")
    cells = cells.join(F.broadcast(full), ["_cx", "_cy"], "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))
    cells = cells.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)))
    cells = cells.withColumn("_meets", F.pmod(F.xxhash64("k"), "_pieces") == F.col("_piece")).drop("_pieces")

    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        n, keys = len(table), table["k"].combine_chunks()
        cx, cy, ax, ay, bx, by = (table[c].to_numpy() for c in ("_cx", "_cy", "ax", "ay", "bx", "by"))
        dx, dy = bx - ax, by - ay
        mx, my, length = (ax + bx) / 2.0, (ay + by) / 2.0, np.hypot(dx, dy)
        # rows are in the order of their keys: those after a row begin where its key ends
        new = np.append(True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))
        new[starts] = True
        places, end = np.append(np.flatnonzero(new), n), np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        after = places[np.searchsorted(places, np.arange(n), "right")]
        many = np.where(table["_meets"].to_numpy(), end - after, 0)
        for i, j in _later(after, many):
            det = dx[i] * dy[j] - dy[i] * dx[j]
            some = np.abs(det) >= least_sine * (1 - 1e-9) * (length[i] * length[j])
            i, j, det = i[some], j[some], det[some]
            x, y = ax[j] - ax[i], ay[j] - ay[i]
            t, s = (x * dy[j] - y * dx[j]) / det, (x * dy[i] - y * dx[i]) / det
            sine = np.abs(det) / (length[i] * length[j])
            some = (t >= margin) & (t <= 1 - margin) & (s >= margin) & (s <= 1 - margin) & (np.degrees(np.arcsin(np.minimum(1.0, sine))) >= least_degrees)
            i, j, t = i[some], j[some], t[some]
            x, y = ax[i] + t * dx[i], ay[i] + t * dy[i]
            some = (np.floor(x / size) == cx[i]) & (np.floor(y / size) == cy[i]) & (np.hypot(mx[i] - mx[j], my[i] - my[j]) <= reach)
            yield pa.table({"a": keys.take(pa.array(i[some])), "b": keys.take(pa.array(j[some])), "x": x[some], "y": y[some]})

    kind = segments.schema[key].dataType.simpleString()
    return sequences.whole_groups(cells, ["_cx", "_cy", "_piece"], ["k"], run, f"a {kind}, b {kind}, x double, y double")


def _later(after: np.ndarray, many: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each row i with `many` rows from after[i] on, some `most` at a time."""
    total, low = np.cumsum(many), 0
    while low < len(many):
        done = total[low] - many[low]
        high = max(low + 1, np.searchsorted(total, done + most, "right"))
        i = np.repeat(np.arange(low, high), many[low:high])
        yield i, np.arange(len(i)) - (total - many)[i] + done + after[i]
        low = high

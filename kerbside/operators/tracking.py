"""Tracking on the ground: a constant-velocity filter for each object and least-cost assignment for each frame.

A camera's frames are one sequence.  Where no detection comes for longer than
`max_age` frames no track survives, so the sequence is cut there and the pieces
are tracked in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import overlap
from .assignment import assign_within
from .fleet import Lanes, track_groups
from .lane_graph import Graph
from .sequences import islands, whole_groups

GATE = 1e6
COVARIANCE = ("c_xx", "c_xy", "c_yy")
#: Rows of small cameras that are tracked at once.
AT_ONCE = 100_000


@dataclass(frozen=True)
class Settings:
    """What the tracker goes by: metres, frames, shares."""

    max_dist: float = 15.0
    max_age: int = 30
    min_hits: int = 3
    high: float = 0.5
    low: float = 0.1
    momentum: float = 2.0
    class_cost: float = 1.0
    chi2: float = 9.21
    mahalanobis: bool = True
    q: float = 1.0
    q_lateral: float = 0.1
    history: int = 30
    reset_gap: int = 3
    noise: float = 0.5
    coast_only: bool = True
    lane_reach: float = 15.0
    off_route: float = 6.0
    lane_limit: float = 150.0
    least_move: float = 0.3
    start_speed: float = 5.0
    reset_speed: float = 3.0


@dataclass
class Track:
    """One object: state (x, y, vx, vy), covariance, last observations."""

    ident: int
    x: np.ndarray
    p: np.ndarray
    frame: int
    kind: str | None
    confidence: float
    hits: int = 1
    age: int = 0
    missed: int = 0
    seen: list = field(default_factory=list)  # (frame, x, y)
    lane: tuple | None = None
    marked: tuple | None = None  # (x, p, lane, age) at the last detection

    def mark(self) -> None:
        """Keeps the state of now, from which it can be predicted again."""
        self.marked = self.x, self.p, self.lane, self.age

    @classmethod
    def born(cls, ident: int, z: np.ndarray, frame: int, kind: str | None, confidence: float, s: Settings) -> Track:
        return cls(ident, np.array([z[0], z[1], 0.0, 0.0]), np.diag([1.0, 1.0, s.start_speed**2, s.start_speed**2]), frame, kind, confidence, seen=[(frame, float(z[0]), float(z[1]))])

    def predict(self, dt: float, s: Settings, graph: Graph | None = None) -> None:
        """One step on.

        On a lane the noise is that of the lane's direction, small across it.
        The place follows the lane at the offset it has, in whichever direction
        the object moves, while it is unseen (or always, if `coast_only` is off).
        """
        f = np.eye(4)
        f[0, 2] = f[1, 3] = dt
        g = np.array([[dt * dt / 2, 0], [0, dt * dt / 2], [dt, 0], [0, dt]])
        noise = np.eye(2) * s.q
        moved = f @ self.x
        if graph is not None and self.lane:
            link, pos, d = self.lane
            t = graph.tangent(link, pos)
            speed = float(np.hypot(*self.x[2:]))
            way = 1.0 if float(self.x[2:] @ t) >= 0 else -1.0
            link, pos = graph.advance(link, pos, way * speed * dt, t * way)
            to = graph.tangent(link, pos)
            self.lane = (link, pos, d)
            if self.missed or not s.coast_only:
                moved = np.concatenate([graph.at(link, pos, d), way * speed * to])
            noise = s.q * (np.outer(to, to) + s.q_lateral * (np.eye(2) - np.outer(to, to)))
        self.x = moved
        self.p = f @ self.p @ f.T + g @ noise @ g.T
        self.age += 1
        self.missed += 1

    def on_lane(self, graph: Graph, z: np.ndarray, s: Settings, k: int = 4) -> None:
        """The lane below a detection, as (link, s, d): least offset, plus a cost for lanes that the one before doesn't lead to; without any in reach the one before stays."""
        found = graph.near(z, s.lane_reach, k)
        if found:
            cut_off = [s.off_route if self.lane and graph.route(self.lane[:2], c[:2], s.lane_limit) is None else 0.0 for c in found]
            self.lane = min(zip(found, cut_off, strict=True), key=lambda c: abs(c[0][2]) + c[1])[0][:3]

    def update(self, z: np.ndarray, frame: int, dt: float, kind: str | None, confidence: float, r: np.ndarray, s: Settings) -> None:
        """A detection; after a gap of `reset_gap` frames position and speed come from the last two observations."""
        gap = frame - self.seen[-1][0]
        if gap >= s.reset_gap:
            last = np.array(self.seen[-1][1:])
            self.x = np.concatenate([z, (z - last) / (gap * dt)])
            self.p = np.zeros((4, 4))
            self.p[:2, :2], self.p[2:, 2:] = r, np.eye(2) * s.reset_speed**2
        else:
            innovation = z - self.x[:2]
            gain = self.p[:, :2] @ np.linalg.inv(self.p[:2, :2] + r)
            self.x = self.x + gain @ innovation
            self.p = self.p - gain @ self.p[:2]
        self.seen = [*self.seen, (frame, float(z[0]), float(z[1]))][-s.history :]
        self.hits += 1
        self.missed = 0
        self.frame, self.confidence = frame, confidence
        self.kind = kind or self.kind

    def direction(self, back: int = 3) -> np.ndarray | None:
        """Unit direction between the last observation and the one `back` before it."""
        if len(self.seen) < 2:
            return None
        a, b = np.array(self.seen[max(0, len(self.seen) - 1 - back)][1:]), np.array(self.seen[-1][1:])
        n = np.hypot(*(b - a))
        return (b - a) / n if n > 1e-6 else None


class Tracker:
    """All objects of one camera."""

    def __init__(self, dt: float, settings: Settings | None = None, graph: Graph | None = None) -> None:
        self.dt, self.settings, self.graph = dt, settings or Settings(), graph
        self.tracks: list[Track] = []
        self.next = 1
        self.frame: int | None = None

    def cost(self, track: Track, detection: dict, place: np.ndarray) -> float:
        """Distance (in deviations where the detection has a covariance, else in metres) with costs for another direction or class; the gate beyond the bounds."""
        s = self.settings
        off = detection["z"] - place
        metres = float(np.hypot(*off))
        if metres > s.max_dist:
            return GATE
        cost = metres
        if s.mahalanobis and detection.get("known", True):
            square = float(off @ np.linalg.solve(track.p[:2, :2] + detection["r"], off))
            if square > s.chi2:
                return GATE
            cost = float(np.sqrt(square))
        u, move = track.direction(), detection["z"] - np.array(track.seen[-1][1:])
        n = np.hypot(*move)
        # what stands has no direction
        if u is not None and n > s.least_move:
            cost += s.momentum * (1.0 - float(u @ move) / n) / 2.0
        if track.kind and detection["class"] and track.kind != detection["class"]:
            cost += s.class_cost
        return cost

    def _match(self, tracks: list[Track], detections: list[int], rows: list[dict], places) -> list[tuple[Track, int]]:
        if not tracks or not detections:
            return []
        c = np.array([[self.cost(t, rows[j], places(t)) for j in detections] for t in tracks])
        return [(tracks[i], detections[j]) for i, j in assign_within(c, GATE)]

    def step(self, frame: int, rows: list[dict]) -> list[int | None]:
        """Track ids of a frame's detections (z, r, confidence, class); None for those without a confirmed track."""
        s = self.settings
        for _ in range(max(1, frame - self.frame) if self.frame is not None else 1):
            for t in self.tracks:
                t.predict(self.dt, s, self.graph)
        self.frame = frame
        strong = [i for i, r in enumerate(rows) if r["confidence"] >= s.high]
        weak = [i for i, r in enumerate(rows) if s.low <= r["confidence"] < s.high]
        owner: dict[int, Track] = {}

        def take(pairs) -> None:
            for t, i in pairs:
                owner[i] = t
                t.update(rows[i]["z"], frame, self.dt, rows[i]["class"], rows[i]["confidence"], rows[i]["r"], s)
                if self.graph is not None:
                    t.on_lane(self.graph, rows[i]["z"], s)

        def left() -> list[Track]:
            busy = {id(t) for t in owner.values()}
            return [t for t in self.tracks if id(t) not in busy]

        take(self._match(self.tracks, strong, rows, lambda t: t.x[:2]))
        take(self._match(left(), weak, rows, lambda t: t.x[:2]))
        take(self._match(left(), [i for i in strong + weak if i not in owner], rows, lambda t: np.array(t.seen[-1][1:])))
        for i in strong:
            if i not in owner:
                t = Track.born(self.next, rows[i]["z"], frame, rows[i]["class"], rows[i]["confidence"], s)
                self.next += 1
                if self.graph is not None:
                    t.on_lane(self.graph, rows[i]["z"], s)
                self.tracks.append(t)
                owner[i] = t
        for t in owner.values():
            t.mark()
        self.tracks = [t for t in self.tracks if t.missed <= s.max_age]
        return [t.ident if (t := owner.get(i)) is not None and (t.hits >= s.min_hits or t.age <= s.min_hits) else None for i in range(len(rows))]


def _detections(rows: pd.DataFrame, noise: float) -> list[dict]:
    cov = rows[["c_xx", "c_xy", "c_yy"]].to_numpy(float) if "c_xx" in rows else np.full((len(rows), 3), np.nan)
    out = []
    for (x, y), (a, b, c), conf, kind in zip(rows[["x", "y"]].to_numpy(float), cov, rows.confidence, rows["class"], strict=True):
        known = bool(np.isfinite([a, b, c]).all())
        out.append({"z": np.array([x, y]), "r": np.array([[a, b], [b, c]]) if known else np.eye(2) * noise, "known": known, "confidence": float(conf), "class": kind})
    return out


def cut_at_gaps(rows: DataFrame, by: str, max_age: int) -> DataFrame:
    """`rows` with _piece, the number of the stretch of frames without a pause that no track survives."""
    gap = F.col("frame") - F.lag("frame").over(Window.partitionBy(by).orderBy("frame")) > max_age
    return islands(rows, [by], ["frame"], F.coalesce(gap, F.lit(False)), "_piece")


def track(rows: DataFrame, fps: float, settings: Settings | None = None, graph: Graph | None = None, by: str = "cctv_id") -> DataFrame:
    """`rows` (by, frame, x, y, confidence, class; optionally c_xx, c_xy, c_yy) with track_id, a text unique for the camera.

    Detections without a ground point keep a null id.
    """
    s = settings or Settings()
    kept = rows.drop("track_id")
    lanes = Lanes(graph, s.lane_limit) if graph is not None and graph.ids else None

    def run(part: pa.Table, starts: np.ndarray) -> pa.Table:
        piece = np.zeros(len(part), np.int64)
        piece[starts] = 1
        column = {c: part[c].to_numpy(zero_copy_only=False) for c in part.column_names if c in ("frame", "x", "y", "confidence", *COVARIANCE)}
        z = np.column_stack([column["x"], column["y"]]).astype(float)
        placed = np.flatnonzero(~np.isnan(z).any(axis=1))
        placed = placed[part["frame"].is_valid().to_numpy()[placed]]
        now = {"frame": column["frame"][placed].astype(np.int64), "z": z[placed], "confidence": column["confidence"][placed].astype(float)}
        cov = np.column_stack([column[c] for c in COVARIANCE]).astype(float)[placed] if COVARIANCE[0] in column else np.full((len(placed), 3), np.nan)
        now["known"] = np.isfinite(cov).all(axis=1)
        now["r"] = np.where(now["known"][:, None, None], cov[:, [0, 1, 1, 2]].reshape(-1, 2, 2), np.eye(2) * s.noise)
        kinds = part["class"].combine_chunks().dictionary_encode()
        code = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)[placed].astype(np.int64)
        empty = [k for k, name in enumerate(kinds.dictionary.to_pylist()) if not name]
        now["kind"] = np.where(np.isin(code, empty), -1, code)
        ids = np.zeros(len(part), np.int64)
        ids[placed] = track_groups((np.cumsum(piece) - 1)[placed], now, 1.0 / fps, s, lanes, GATE)
        name = pc.binary_join_element_wise(part["_piece"].cast(pa.string()), pa.array(ids).cast(pa.string()), "-")
        name = pc.if_else(pa.array(ids > 0), name, pa.scalar(None, pa.string()))
        return part.drop_columns(["_piece"]).append_column("track_id", name)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return whole_groups(cut_at_gaps(kept, by, s.max_age), [by, "_piece"], ["frame", "x", "y"], run, f"{fields}, track_id string", AT_ONCE)


def track_by_overlap(rows: DataFrame, threshold: float = 0.3, max_age: int = 30, by: str = "cctv_id") -> DataFrame:
    """A plain baseline in the image: each frame's boxes go to the tracks whose last box they overlap most, the best pair first.

    A camera's frames are cut where no box comes for longer than `max_age`
    frames, as in `track`, and where no box before overlaps one behind enough
    (see `overlap`); track_id is a text unique for the camera.
    """
    return overlap.track(rows.drop("track_id"), threshold, max_age, by)


def simulate(seed: int, frames: int = 150, fps: float = 30.0, lanes: int = 2, vehicles: int = 3, jitter: float = 0.3, dropout: float = 0.2, false_rate: float = 0.05) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(truth, detections) of vehicles on parallel lanes, from a seed; false detections come at random."""
    rng = np.random.default_rng(seed)
    truth = []
    for lane in range(lanes):
        for v in range(vehicles):
            speed, start = rng.uniform(8, 16), -25.0 * v
            truth += [(f, lane * 100 + v, start + speed * f / fps, 3.5 * lane) for f in range(frames)]
    t = pd.DataFrame(truth, columns=["frame", "track_id", "x", "y"])
    seen = t[rng.random(len(t)) >= dropout].copy()
    seen[["x", "y"]] += rng.normal(0, jitter, (len(seen), 2))
    seen["confidence"] = rng.uniform(0.5, 1.0, len(seen))
    n = rng.poisson(false_rate * frames)
    false = pd.DataFrame({"frame": rng.integers(0, frames, n), "track_id": -1, "x": rng.uniform(-50, 80, n), "y": rng.uniform(-5, 3.5 * lanes + 5, n), "confidence": rng.uniform(0.1, 0.6, n)})
    found = pd.concat([seen, false], ignore_index=True).sort_values("frame", kind="stable")
    return t, found.assign(cctv_id="sim", **{"class": "car"}).drop(columns="track_id").reset_index(drop=True)

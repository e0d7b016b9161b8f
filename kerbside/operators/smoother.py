"""Speed and heading of one track, row by row.

The same class serves a batch (a track in one task) and a stream (its state is a
plain dictionary).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .sequences import deal


@dataclass(frozen=True)
class Settings:
    """What the smoother goes by: metres, km/h, degrees, shares."""

    fastest_kmh: float = 200.0
    history: int = 8
    jitter_m: float = 0.5
    jitter_rows: int = 5
    speed_alpha: float = 0.4
    direction_alpha: float = 0.25
    alpha_min: float = 0.05
    alpha_max: float = 0.4
    speed_ref: float = 30.0
    turn_max: float = 30.0
    least_kmh: float = 3.0
    guide_share: float = 0.3
    guide_within: float = 15.0
    line_rows: int = 3
    line_m: float = 2.0
    step_m: float = 0.5


def _wrap(a: float) -> float:
    return (a + 180.0) % 360.0 - 180.0


class Smoother:
    """State of one track; `state` survives as JSON."""

    def __init__(self, settings: Settings | None = None, state: dict | None = None) -> None:
        self.settings = settings or Settings()
        self.state = state or {"history": [], "speed": None, "heading": None, "direction": None}

    def _jittering(self) -> bool:
        recent = self.state["history"][-self.settings.jitter_rows :]
        if len(recent) < self.settings.jitter_rows:
            return False
        xs, ys = zip(*recent, strict=True)
        return math.hypot(max(xs) - min(xs), max(ys) - min(ys)) < self.settings.jitter_m

    def _raw_heading(self) -> float | None:
        xs, ys = zip(*self.state["history"], strict=True)
        n, dx, dy = len(xs), xs[-1] - xs[0], ys[-1] - ys[0]
        if n >= self.settings.line_rows and math.hypot(dx, dy) >= self.settings.line_m:
            mx, my = sum(xs) / n, sum(ys) / n
            xx, yy, xy = (sum((u - p) * (v - q) for u, v in zip(one, other, strict=True)) for one, p, other, q in ((xs, mx, xs, mx), (ys, my, ys, my), (xs, mx, ys, my)))
            angle = 0.5 * math.atan2(2 * xy, xx - yy)  # main axis of the points
            along = math.cos(angle), math.sin(angle)
            sign = -1.0 if along[0] * dx + along[1] * dy < 0 else 1.0
            return math.degrees(math.atan2(sign * along[1], sign * along[0]))
        if n >= 2:
            dx, dy = xs[-1] - xs[-2], ys[-1] - ys[-2]
            if math.hypot(dx, dy) > self.settings.step_m:
                return math.degrees(math.atan2(dy, dx))
        return None

    def update(self, x: float, y: float, dt: float, guide: float | None = None) -> tuple[float | None, float | None]:
        """(speed in km/h, heading) after a point `dt` seconds later; a jump faster than is possible changes nothing."""
        c, s = self.settings, self.state
        raw = None
        if s["history"] and dt > 0:
            raw = math.hypot(x - s["history"][-1][0], y - s["history"][-1][1]) / dt * 3.6
            if raw > c.fastest_kmh:
                return s["speed"], s["heading"]
        s["history"] = [*s["history"], [x, y]][-c.history :]
        if raw is None:
            return s["speed"], s["heading"]
        still = self._jittering()
        seen = 0.0 if still else raw
        s["speed"] = seen if s["speed"] is None else c.speed_alpha * seen + (1 - c.speed_alpha) * s["speed"]
        turned = self._raw_heading()
        if turned is not None and raw > c.least_kmh and not still:
            u = math.cos(math.radians(turned)), math.sin(math.radians(turned))
            d = u if s["direction"] is None else tuple(c.direction_alpha * v + (1 - c.direction_alpha) * w for v, w in zip(u, s["direction"], strict=True))
            n = math.hypot(*d)
            d = (d[0] / n, d[1] / n) if n > 1e-9 else u
            s["direction"] = list(d)
            wanted = math.degrees(math.atan2(d[1], d[0]))
            if s["heading"] is None:
                s["heading"] = wanted
            else:
                alpha = c.alpha_min + (c.alpha_max - c.alpha_min) * min(1.0, (s["speed"] or 0.0) / c.speed_ref)
                s["heading"] = _wrap(s["heading"] + max(-c.turn_max, min(c.turn_max, alpha * _wrap(wanted - s["heading"]))))
        if guide is not None and s["heading"] is not None:
            off = _wrap(guide - s["heading"])
            if abs(off) <= c.guide_within:
                s["heading"] = _wrap(s["heading"] + c.guide_share * off)
        return s["speed"], s["heading"]


def smooth_rows(rows: Iterator[tuple], fps: float, smoother: Smoother, last_frame: int | None = None) -> Iterator[tuple[float | None, float | None, int]]:
    """(speed, heading, frame) for rows (frame, x, y, guide) in order; time counts from the frame seen last, even one that was refused."""
    for frame, x, y, guide in rows:
        speed, heading = smoother.update(x, y, (frame - last_frame) / fps if last_frame is not None else 0.0, guide)
        last_frame = frame
        yield speed, heading, frame


def smooth(rows: DataFrame, by: list[str], fps: float, settings: Settings | None = None) -> DataFrame:
    """`rows` (by, frame, x, y, optionally guide) with speed_kmh and heading; a track in one task.  Rows without a point, and those without a track, have nulls."""
    has_guide = "guide" in rows.columns

    def run(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values("frame", kind="stable").reset_index(drop=True)
        known = (track.x.notna() & track.y.notna() & track[by].notna().all(axis=1)).to_numpy()
        some = track[known]
        guides = [None if pd.isna(g) else float(g) for g in some.guide] if has_guide else [None] * len(some)
        out = list(smooth_rows(zip(some.frame.tolist(), some.x.tolist(), some.y.tolist(), guides, strict=True), fps, Smoother(settings)))
        for k, name in enumerate(("speed_kmh", "heading")):
            values = np.full(len(track), np.nan)
            values[known] = [np.nan if o[k] is None else o[k] for o in out]
            track[name] = pd.array([None if np.isnan(v) else v for v in values], dtype="Float64")
        return track

    kept = rows.drop("speed_kmh", "heading")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return deal(kept, *by).groupBy(*by).applyInPandas(run, f"{fields}, speed_kmh double, heading double")

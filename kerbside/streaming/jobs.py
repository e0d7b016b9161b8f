"""Structured Streaming: the smoother and the tracker with keyed state, time windows and sessions.

State is kept by transformWithStateInPandas on RocksDB, in maps of typed values:
one entry for each track of the smoother; for the tracker one for each camera
and one for each live track.  Tracks and cameras are dealt to GROUPS groups by a
hash, so that a call takes many; a stream's checkpoint holds for one number of
groups.  An entry holds a track as it was at its last detection and is written
only then: in later batches it is predicted from there, step by step, as a batch
would.  So what a batch writes follows the tracks it touches, not those a camera
holds.

A stream and a batch of the same rows give the same results.  Rows of a
micro-batch are ordered by frame; frames that come again, or after a later one
has been handled, are dropped, as are rows later than the watermark.  Rows
without a point or a frame keep nulls and change nothing.  With `late`, rows
carry event time `ts` and state goes by timers of it, so that results don't
depend on the load; without, timers follow the clock.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import smoother, tracking
from ..operators.fleet import Fleet, Lanes, track_groups
from ..operators.lane_graph import Graph

#: The state store that keyed state with timers and maps needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: The worker's rows are named tuples, in which `class` is no name.
RENAMED = {"class": "kind"}
#: Groups that tracks or cameras are dealt to.
GROUPS = 256


def _keyed(rows: DataFrame, processor: _Keyed, schema: str, late: str | None) -> DataFrame:
    """The stream of what `processor` makes of the rows of each key; sets the session's state store provider."""
    wanted = [*(F.col(c).cast("string").alias(c) for c in processor.keys), *(c for c in processor.reads if c in rows.columns)]
    if late is None:
        timed, mode = rows.select(*wanted), "ProcessingTime" if processor.idle_ms else "None"
    elif not processor.idle_ms:
        raise ValueError("event time is used to expire state: give idle_ms")
    else:
        timed, mode = event_time(rows).withWatermark("ts", late).select(*wanted, "ts", F.unix_millis("ts").alias("event_ms")), "EventTime"
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    dealt = timed.withColumn("dealt", F.pmod(F.xxhash64(*processor.keys), F.lit(GROUPS))).withColumnsRenamed(RENAMED)
    return dealt.groupBy("dealt").transformWithStateInPandas(processor, schema, "Append", mode)


def event_time(rows: DataFrame, column: str = "ts") -> DataFrame:
    """`rows` with a timestamp that watermarks accept (one with a time zone)."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


class _Keyed(StatefulProcessor):
    """State of each key, which goes `idle_ms` after its newest row: a group's timer goes off at the earliest of its keys' times."""

    keys: tuple[str, ...] = ()

    def __init__(self, idle_ms: int | None, by_event: bool) -> None:
        self.idle_ms, self.by_event = idle_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.until = handle.getMapState("until", self.kinds(), "at long")

    def kinds(self) -> str:
        return ", ".join(f"{c} string" for c in self.keys)

    def coded(self, rows: pd.DataFrame) -> tuple[np.ndarray, list[tuple]]:
        """(the number of each row's key, the keys)."""
        columns = [[None if v is None or v != v else v for v in rows[c].tolist()] for c in self.keys]
        number: dict[tuple, int] = {}
        codes = np.array([number.setdefault(key, len(number)) for key in zip(*columns, strict=True)], np.int64)
        return codes, list(number)

    def _clock(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.by_event else timers.getCurrentProcessingTimeInMs()

    def _ring(self, at: int) -> None:
        """Sees to it that the timer goes off at that time or before."""
        if self.timer.exists():
            was = self.timer.get()[0]
            if was <= at:
                return
            self.handle.deleteTimer(was)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _wind(self, timers, rows: pd.DataFrame) -> None:
        """Puts off the times of the rows' keys."""
        if not self.idle_ms:
            return
        now = self._clock(timers)
        codes, names = self.coded(rows)
        newest = rows.event_ms.groupby(codes).max() if self.by_event else pd.Series(np.nan, range(len(names)))
        times = [max((now if np.isnan(v) else int(v)) + self.idle_ms, now + 1) for v in newest]
        for name, at in zip(names, times, strict=True):
            self.until.updateValue(name, (at,))
        self._ring(min(times))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = pd.concat(list(rows), ignore_index=True)
        self._wind(timerValues, now)
        placed = now[["frame", "x", "y"]].notna().all(axis=1)
        yield from self.take(now[placed].astype({"frame": "int64", "x": float, "y": float}))
        if not placed.all():
            yield self.unplaced(now[~placed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, gone, rest = self._clock(timerValues), set(), []
        for name, (at,) in list(self.until.iterator()):
            if at <= now:
                gone.add(tuple(name))
            else:
                rest.append(at)
        for name in gone:
            self.until.removeKey(name)
        self.forget(gone)
        self.timer.clear()
        if rest:
            self._ring(min(rest))
        return iter(())

    def close(self) -> None:
        pass


def _column(values: list, dtype: str) -> pd.Series:
    return pd.Series(values, dtype=dtype)


def _nulls(n: int, dtype: str) -> pd.Series:
    return _column([None] * n, dtype)


class _Smooth(_Keyed):
    keys = ("cctv_id", "track_id")
    reads = ("frame", "x", "y")

    def __init__(self, fps: float, settings: smoother.Settings, idle_ms: int | None, by_event: bool) -> None:
        super().__init__(idle_ms, by_event)
        self.fps, self.settings = fps, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.track = handle.getMapState("track", self.kinds(), "frame long, x array<double>, y array<double>, speed double, heading double, direction array<double>")

    def forget(self, names: set[tuple]) -> None:
        for name in names:
            if self.track.containsKey(name):
                self.track.removeKey(name)

    def take(self, now: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(now):
            return
        codes, names = self.coded(now)
        order = np.lexsort((now.frame.to_numpy(), codes))
        now, codes = now.iloc[order], codes[order]
        held = {tuple(name): value for name, value in self.track.iterator()}
        frames, xs, ys = (now[c].tolist() for c in ("frame", "x", "y"))
        kept = np.ones(len(now), bool)
        speeds: list[float | None] = [None] * len(now)
        headings = speeds.copy()
        ends = np.searchsorted(codes, np.arange(len(names)), side="right").tolist()
        for name, a, b in zip(names, [0, *ends[:-1]], ends, strict=True):
            if name[1] is None:
                continue
            last, state = None, None
            if name in held:
                last, x, y, speed, heading, direction = held[name]
                state = {"history": [list(p) for p in zip(x, y, strict=True)], "speed": speed, "heading": heading, "direction": list(direction) if direction is not None else None}
                old = sum(f <= last for f in frames[a:b])
                kept[a : a + old] = False
                a += old
            if a == b:
                continue
            machine = smoother.Smoother(self.settings, state)
            out = list(smoother.smooth_rows(zip(frames[a:b], xs[a:b], ys[a:b], itertools.repeat(None)), self.fps, machine, last))
            speeds[a:b], headings[a:b] = [o[0] for o in out], [o[1] for o in out]
            s = machine.state
            self.track.updateValue(name, (frames[b - 1], [p[0] for p in s["history"]], [p[1] for p in s["history"]], s["speed"], s["heading"], s["direction"]))
        out = now[["cctv_id", "track_id", "frame", "x", "y"]].reset_index(drop=True)
        out = out.assign(speed_kmh=_column(speeds, "float64"), heading=_column(headings, "float64"))[kept]
        if len(out):
            yield out

    def unplaced(self, rows: pd.DataFrame) -> pd.DataFrame:
        none = _nulls(len(rows), "float64")
        return pd.DataFrame({"cctv_id": rows.cctv_id.to_numpy(), "track_id": rows.track_id.to_numpy(), "frame": rows.frame.astype("Int64").to_numpy(), "x": rows.x.to_numpy(float), "y": rows.y.to_numpy(float), "speed_kmh": none, "heading": none})


def smooth(rows: DataFrame, fps: float, settings: smoother.Settings | None = None, idle_ms: int | None = 60_000, late: str | None = None) -> DataFrame:
    """Rows (cctv_id, track_id, frame, x, y, speed_kmh, heading) of a stream (cctv_id, track_id, frame, x, y).

    A track's state goes after `idle_ms` without rows, or never if that is
    None.  Rows without a point, a frame or a track have nulls.
    """
    schema = "cctv_id string, track_id string, frame long, x double, y double, speed_kmh double, heading double"
    return _keyed(rows, _Smooth(fps, settings or smoother.Settings(), idle_ms, late is not None), schema, late)


class _Track(_Keyed):
    keys = ("cctv_id",)
    reads = ("frame", "x", "y", "confidence", "class", *tracking.COVARIANCE)

    def __init__(self, fps: float, settings: tracking.Settings, idle_ms: int | None, by_event: bool, graph: Graph | None) -> None:
        super().__init__(idle_ms, by_event)
        self.fps, self.settings = fps, settings
        self.ids = graph.ids if graph is not None else []
        self.lanes = Lanes(graph, settings.lane_limit) if self.ids else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.camera = handle.getMapState("camera", self.kinds(), "began long, next long, frame long")
        self.live = handle.getMapState("tracks", f"{self.kinds()}, ident long", "x array<double>, p array<double>, frame long, kind string, hits long, age long, xs array<double>, ys array<double>, link string, s double, d double")

    def forget(self, names: set[tuple]) -> None:
        gone = [tuple(k) for k, _ in self.live.iterator() if (k[0],) in names]
        for key in gone:
            self.live.removeKey(key)
        for name in names:
            if self.camera.containsKey(name):
                self.camera.removeKey(name)

    def _thaw(self, fleet: Fleet, code: dict[tuple, int], last: np.ndarray, kinds: dict[str, int]) -> list[tuple]:
        """Puts the live tracks of the cameras back, each predicted from its last detection to its camera's last frame; their keys."""
        held = sorted(((code[name], ident, value) for (camera, ident), value in self.live.iterator() if (name := (camera,)) in code), key=lambda h: h[:2])
        if not held:
            return []
        t, links = fleet._empty(len(held)), {link: i for i, link in enumerate(self.ids)}
        for i, (group, ident, (x, p, frame, kind, hits, age, xs, ys, link, s, d)) in enumerate(held):
            n = min(len(xs), fleet.back)
            t["group"][i], t["ident"][i], t["frame"][i], t["hits"][i], t["age"][i], t["kept"][i] = group, ident, frame, hits, age, n
            t["x"][i], t["p"][i] = x, np.reshape(p, (4, 4))
            t["kind"][i] = kinds.setdefault(kind, len(kinds)) if kind else -1
            t["seen"][i, :n] = np.column_stack([xs, ys])[:n]
            t["link"][i], t["pos"][i], t["d"][i] = (-1, 0.0, 0.0) if link is None else (links[link], s, d)
        fleet.state = t
        fleet._mark(np.arange(len(held)))
        steps = last[t["group"]] - t["frame"]
        for k in range(int(steps.max(initial=0))):
            fleet.predict(np.flatnonzero(steps > k))
        return [(group, ident) for group, ident, _ in held]

    def _freeze(self, fleet: Fleet, names: list[tuple], before: np.ndarray, seen: np.ndarray, held: list[tuple], kinds: dict[str, int]) -> None:
        """Writes the tracks with detections in this batch, and removes those that are gone."""
        t, kind = fleet.state, [*kinds]
        for i in np.flatnonzero(~seen[t["group"]] | (t["frame"] > before[t["group"]])):
            n, link = t["kept"][i], t["at_link"][i]
            lane = (None, None, None) if link < 0 else (self.ids[link], float(t["at_pos"][i]), float(t["at_d"][i]))
            value = (t["at_x"][i].tolist(), t["at_p"][i].ravel().tolist(), int(t["frame"][i]), None if t["kind"][i] < 0 else kind[t["kind"][i]], int(t["hits"][i]), int(t["at_age"][i]), *t["seen"][i, :n].T.tolist(), *lane)
            self.live.updateValue((*names[t["group"][i]], int(t["ident"][i])), value)
        for group, ident in set(held) - set(zip(t["group"].tolist(), t["ident"].tolist(), strict=True)):
            self.live.removeKey((*names[group], ident))

    def take(self, now: pd.DataFrame) -> Iterator[pd.DataFrame]:
        known = {tuple(name): value for name, value in self.camera.iterator()} if len(now) else {}
        codes, names = self.coded(now)
        old = np.array([known[n][2] if n in known else np.iinfo(np.int64).min for n in names], np.int64)
        now = now[now.frame.to_numpy() > old[codes]]
        if not len(now):
            return
        codes, names = self.coded(now)
        order = np.lexsort((now.y.to_numpy(), now.x.to_numpy(), now.frame.to_numpy(), codes))
        now, codes = now.iloc[order], codes[order]
        frame, first = now.frame.to_numpy(), np.searchsorted(codes, np.arange(len(names)))
        seen = np.array([n in known for n in names])
        began = [known[n][0] if n in known else int(frame[a]) for n, a in zip(names, first, strict=True)]
        before = np.array([known[n][2] if n in known else 0 for n in names], np.int64)
        fleet = Fleet(len(names), 1.0 / self.fps, self.settings, self.lanes, marks=True)
        fleet.next = np.array([known[n][1] if n in known else 1 for n in names], np.int64)
        kinds: dict[str, int] = {}
        held = self._thaw(fleet, {n: i for i, n in enumerate(names)}, before, kinds)
        cov = now[list(tracking.COVARIANCE)].to_numpy(float) if tracking.COVARIANCE[0] in now else np.full((len(now), 3), np.nan)
        sure = np.isfinite(cov).all(axis=1)
        rows = {"frame": frame, "z": now[["x", "y"]].to_numpy(float), "confidence": now.confidence.to_numpy(float), "known": sure}
        rows["r"] = np.where(sure[:, None, None], cov[:, [0, 1, 1, 2]].reshape(-1, 2, 2), np.eye(2) * self.settings.noise)
        rows["kind"] = np.array([kinds.setdefault(k, len(kinds)) if isinstance(k, str) and k else -1 for k in now.kind.tolist()], np.int64)
        last, had = before.copy(), seen.copy()
        ids = track_groups(codes, rows, 1.0 / self.fps, self.settings, self.lanes, tracking.GATE, (fleet, last, had))
        self._freeze(fleet, names, before, seen, held, kinds)
        for name, start, number, end in zip(names, began, fleet.next.tolist(), last.tolist(), strict=True):
            self.camera.updateValue(name, (start, number, end))
        yield pd.DataFrame({"cctv_id": now.cctv_id.to_numpy(), "frame": frame, "x": now.x.to_numpy(), "y": now.y.to_numpy(), "track_id": [f"{began[c]}-{i}" if i else None for c, i in zip(codes.tolist(), ids.tolist(), strict=True)]})

    def unplaced(self, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cctv_id": rows.cctv_id.to_numpy(), "frame": rows.frame.astype("Int64").to_numpy(), "x": rows.x.to_numpy(float), "y": rows.y.to_numpy(float), "track_id": [None] * len(rows)})


def track(rows: DataFrame, fps: float, settings: tracking.Settings | None = None, idle_ms: int | None = 60_000, graph: Graph | None = None, late: str | None = None) -> DataFrame:
    """Rows (cctv_id, frame, x, y, track_id) of a stream (cctv_id, frame, x, y, confidence, class), keyed by camera, on a lane graph where one is given.

    Tracks expire `max_age` frames after their last detection, and are confirmed
    by `min_hits`; a camera's state goes after `idle_ms` without rows.  track_id
    begins with the frame that the camera's state began with, so that ids are
    unique when a camera comes back.  Rows without a point or a frame have a
    null track_id.
    """
    schema = "cctv_id string, frame long, x double, y double, track_id string"
    return _keyed(rows, _Track(fps, settings or tracking.Settings(), idle_ms, late is not None, graph), schema, late)


def counts(rows: DataFrame, length: str = "1 minute", late: str = "10 minutes", by: str = "class") -> DataFrame:
    """Rows (start, by, n) for windows of time; works on streams (append mode) and tables."""
    windows = rows.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return windows.select(F.col("w.start").alias("start"), by, "n")


def sessions(rows: DataFrame, gap: str = "5 minutes", late: str = "10 minutes", by: str = "track_id") -> DataFrame:
    """Rows (by, start, end, n): stretches of a track without a pause of `gap`; works on streams (append mode) and tables."""
    windows = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return windows.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

"""`tracking.Tracker` for many cameras at once: the k-th frames of all of them are one step on arrays.

Tracks and detections of all cameras lie flat, camera after camera, tracks in
the order of their birth, so that ties fall as they do one camera at a time.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np

from .assignment import assign_groups
from .lane_graph import BACK_M, Graph

if TYPE_CHECKING:
    from .tracking import Settings


class Lanes:
    """A lane graph as arrays: links by number, in the order of their ids."""

    def __init__(self, graph: Graph, limit: float) -> None:
        ids, n = graph.ids, len(graph.ids)
        code = {k: i for i, k in enumerate(ids)}
        self.size = np.array([len(graph.along[k]) for k in ids])
        most = int(self.size.max())
        self.along, self.points = np.full((n, most), np.inf), np.zeros((n, most, 2))
        for i, k in enumerate(ids):
            self.along[i, : self.size[i]], self.points[i, : self.size[i]] = graph.along[k], graph.points[k]
        self.length = self.along[np.arange(n), self.size - 1]
        self.low, self.high = (np.array([f(graph.points[k], axis=0) for k in ids]) for f in (np.min, np.max))
        self.next = np.full((n, max(1, max(len(v) for v in graph.successors.values()))), -1)
        for i, k in enumerate(ids):
            near = sorted(code[x] for x in graph.successors[k])
            self.next[i, : len(near)] = near
        self.start = np.array([graph.tangent(k, 0.0) for k in ids])
        self.joined = np.array([[graph.gap(a, b, limit) is not None for b in ids] for a in ids])

    def _piece(self, link: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.clip((self.along[link] < s[:, None]).sum(axis=1), 1, self.size[link] - 1)

    def tangent(self, link: np.ndarray, s: np.ndarray) -> np.ndarray:
        i = self._piece(link, s)
        d = self.points[link, i] - self.points[link, i - 1]
        n = np.hypot(d[:, 0], d[:, 1])[:, None]
        return np.where(n > 0, d / np.where(n > 0, n, 1.0), [1.0, 0.0])

    def at(self, link: np.ndarray, s: np.ndarray, d: np.ndarray) -> np.ndarray:
        s = np.clip(s, 0.0, self.length[link])
        i, t = self._piece(link, s), self.tangent(link, s)
        a, p = self.along[link, i - 1], self.points[link, i - 1]
        wide = self.along[link, i] - a
        share = np.divide(s - a, wide, out=np.zeros(len(s)), where=wide > 0)[:, None]
        return p + share * (self.points[link, i] - p) + d[:, None] * np.column_stack([-t[:, 1], t[:, 0]])

    def advance(self, link: np.ndarray, s: np.ndarray, ds: np.ndarray, toward: np.ndarray, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
        link, s = link.copy(), s + ds
        for _ in range(most):
            go = np.flatnonzero((ds > 0) & (s > self.length[link]) & (self.next[link, 0] >= 0))
            if not len(go):
                break
            s[go] -= self.length[link[go]]
            after = self.next[link[go]]
            best = np.where(after >= 0, (self.start[after] * toward[go, None]).sum(axis=2), -np.inf)
            # of equal ones the last
            link[go] = after[np.arange(len(go)), after.shape[1] - 1 - np.argmax(best[:, ::-1], axis=1)]
        return link, np.clip(s, 0.0, self.length[link])

    def near(self, points: np.ndarray, distance: float, k: int) -> tuple[np.ndarray, ...]:
        """(point, link, s, d) of up to k links within reach of each point, least |d| first."""
        box = ((points[:, None] >= self.low - distance) & (points[:, None] <= self.high + distance)).all(axis=2)
        row, link = np.nonzero(box)
        p, a = self.points[link], self.along[link]
        inside = np.arange(1, p.shape[1]) < self.size[link][:, None]
        v = p[:, 1:] - p[:, :-1]
        n = np.maximum((v**2).sum(axis=2), 1e-12)
        q = points[row][:, None] - p[:, :-1]
        t = np.clip((q * v).sum(axis=2) / n, 0.0, 1.0)
        off = q - t[:, :, None] * v
        r = np.where(inside, np.hypot(off[..., 0], off[..., 1]), np.inf)
        i = np.argmin(r, axis=1)
        at = np.arange(len(row))
        s = a[at, i] + t[at, i] * (a[at, i + 1] - a[at, i])
        w = self.tangent(link, s)
        d = off[at, i, 1] * w[:, 0] - off[at, i, 0] * w[:, 1]
        some = np.flatnonzero(r[at, i] <= distance)
        some = some[np.lexsort((link[some], np.abs(d[some]), row[some]))]
        rank = np.arange(len(some)) - np.searchsorted(row[some], row[some])
        some = some[rank < k]
        return row[some], link[some], s[some], d[some]


#: What a prediction changes.
MARKED = ("x", "p", "age", "link", "pos", "d")


class Fleet:
    """All objects of many cameras, as flat arrays with `group`, the number of the camera."""

    def __init__(self, groups: int, dt: float, settings: Settings, lanes: Lanes | None, marks: bool = False) -> None:
        self.marks = marks
        self.dt, self.settings, self.lanes = dt, settings, lanes
        self.next = np.ones(groups, np.int64)
        self.back = max(1, min(4, settings.history))
        # seen: the last places, the newest first
        self.state = self._empty(0)

    def _empty(self, n: int) -> dict[str, np.ndarray]:
        whole = {c: np.zeros(n, np.int64) for c in ("group", "ident", "kind", "frame", "hits", "age", "missed", "kept", "link")}
        out = whole | {"x": np.zeros((n, 4)), "p": np.zeros((n, 4, 4)), "seen": np.zeros((n, self.back, 2)), "pos": np.zeros(n), "d": np.zeros(n)}
        return out | ({f"at_{c}": out[c].copy() for c in MARKED} if self.marks else {})

    def _mark(self, i: np.ndarray) -> None:
        """Keeps objects as they are at their last detection."""
        if self.marks:
            for c in MARKED:
                self.state[f"at_{c}"][i] = self.state[c][i]

    def predict(self, some: np.ndarray) -> None:
        """One step on, see `Track.predict`."""
        t, s, dt = self.state, self.settings, self.dt
        f = np.eye(4)
        f[0, 2] = f[1, 3] = dt
        g = np.array([[dt * dt / 2, 0], [0, dt * dt / 2], [dt, 0], [0, dt]])
        x = t["x"][some]
        moved = np.column_stack([x[:, :2] + dt * x[:, 2:], x[:, 2:]])
        added = np.broadcast_to(g @ (np.eye(2) * s.q) @ g.T, (len(some), 4, 4))
        if self.lanes is not None and (on := np.flatnonzero(t["link"][some] >= 0)).size:
            at = some[on]
            along = self.lanes.tangent(t["link"][at], t["pos"][at])
            v = x[on, 2:]
            speed = np.hypot(v[:, 0], v[:, 1])
            way = np.where((v * along).sum(axis=1) >= 0, 1.0, -1.0)
            link, pos = self.lanes.advance(t["link"][at], t["pos"][at], way * speed * dt, along * way[:, None])
            to = self.lanes.tangent(link, pos)
            t["link"][at], t["pos"][at] = link, pos
            coast = np.flatnonzero((t["missed"][at] > 0) | (not s.coast_only))
            moved[on[coast]] = np.column_stack([self.lanes.at(link, pos, t["d"][at])[coast], ((way * speed)[:, None] * to)[coast]])
            outer = to[:, :, None] * to[:, None]
            added = added.copy()
            added[on] = g @ (s.q * (outer + s.q_lateral * (np.eye(2) - outer))) @ g.T
        t["x"][some] = moved
        t["p"][some] = f @ t["p"][some] @ f.T + added
        t["age"][some] += 1
        t["missed"][some] += 1

    def cost(self, i: np.ndarray, z: np.ndarray, r: np.ndarray, known: np.ndarray, kind: np.ndarray, place: np.ndarray, gate: float) -> np.ndarray:
        """Costs of pairs of tracks and detections, see `Tracker.cost`."""
        s, t = self.settings, self.state
        off = z - place
        cost = np.hypot(off[:, 0], off[:, 1])
        near = np.flatnonzero(~(cost > s.max_dist))
        out = np.full(len(i), gate)
        i, off, cost = i[near], off[near], cost[near]
        if s.mahalanobis and len(near):
            m = np.flatnonzero(known[near])
            square = (off[m] * np.linalg.solve(t["p"][i[m], :2, :2] + r[near[m]], off[m][:, :, None])[:, :, 0]).sum(axis=1)
            cost[m] = np.where(square > s.chi2, gate, np.sqrt(square))
        last, back = t["seen"][i, 0], t["seen"][i, np.minimum(3, t["kept"][i] - 1)]
        u, move = last - back, z[near] - last
        length, n = np.hypot(u[:, 0], u[:, 1]), np.hypot(move[:, 0], move[:, 1])
        turns = (length > 1e-6) & (n > s.least_move)
        share = np.divide((u * move).sum(axis=1), length * n, out=np.zeros(len(n)), where=turns)
        cost = cost + np.where(turns, s.momentum * (1.0 - share) / 2.0, 0.0)
        cost = cost + np.where((t["kind"][i] >= 0) & (kind[near] >= 0) & (t["kind"][i] != kind[near]), s.class_cost, 0.0)
        out[near] = np.where(cost < gate, cost, gate)
        return out

    def _match(self, i: np.ndarray, j: np.ndarray, now: dict, places: np.ndarray, gate: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the tracks i and detections j, both camera by camera."""
        n, m = (np.bincount(g, minlength=len(self.next)) for g in (self.state["group"][i], now["group"][j]))
        both = np.flatnonzero((n > 0) & (m > 0))
        if not len(both):
            return i[:0], j[:0]
        i, j = i[np.isin(self.state["group"][i], both)], j[np.isin(now["group"][j], both)]
        n, m = n[both], m[both]
        each = np.repeat(m, n)  # detections for each track
        first = np.repeat(np.concatenate([[0], np.cumsum(m)[:-1]]), n)
        a = np.repeat(np.arange(len(i)), each)
        b = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
        rows, columns = assign_groups(n, m, self.cost(i[a], now["z"][j[b]], now["r"][j[b]], now["known"][j[b]], now["kind"][j[b]], places[i[a]], gate), gate)
        return i[rows], j[columns]

    def _update(self, i: np.ndarray, j: np.ndarray, now: dict) -> None:
        """Detections j of the tracks i, see `Track.update`."""
        t, s = self.state, self.settings
        z, r, frame = now["z"][j], now["r"][j], now["frame"][j]
        gap = frame - t["frame"][i]
        x, p = t["x"][i], t["p"][i]
        gain = p[:, :, :2] @ np.linalg.inv(p[:, :2, :2] + r)
        new_x, new_p = x + (gain @ (z - x[:, :2])[:, :, None])[:, :, 0], p - gain @ p[:, :2]
        reset = np.flatnonzero(gap >= s.reset_gap)
        new_x[reset] = np.column_stack([z[reset], (z[reset] - t["seen"][i[reset], 0]) / (gap[reset] * self.dt)[:, None]])
        new_p[reset] = 0.0
        new_p[reset, :2, :2], new_p[reset, 2:, 2:] = r[reset], np.eye(2) * s.reset_speed**2
        t["x"][i], t["p"][i] = new_x, new_p
        t["seen"][i, 1:] = t["seen"][i, :-1]
        t["seen"][i, 0] = z
        t["kept"][i] = np.minimum(t["kept"][i] + 1, self.back)
        t["hits"][i] += 1
        t["missed"][i] = 0
        t["frame"][i] = frame
        t["kind"][i] = np.where(now["kind"][j] >= 0, now["kind"][j], t["kind"][i])
        self._on_lane(i, z)
        self._mark(i)

    def _on_lane(self, i: np.ndarray, z: np.ndarray, k: int = 4) -> None:
        if self.lanes is None or not len(i):
            return
        t, s = self.state, self.settings
        row, link, pos, d = self.lanes.near(z, s.lane_reach, k)
        if not len(row):
            return
        old, was = t["link"][i][row], t["pos"][i][row]
        on = np.where(old == link, pos - was >= -BACK_M, self.lanes.joined[old, link])
        weight = np.abs(d) + np.where((old >= 0) & ~on, s.off_route, 0.0)
        order = np.lexsort((np.arange(len(row)), weight, row))
        best = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        at = i[row[best]]
        t["link"][at], t["pos"][at], t["d"][at] = link[best], pos[best], d[best]

    def step(self, now: dict, steps: np.ndarray, gate: float) -> np.ndarray:
        """Track numbers (0 for none) of the detections of one frame of each camera: `now` by camera, place; steps: frames since the camera's last."""
        s, t = self.settings, self.state
        ahead = steps[t["group"]]
        for k in range(int(ahead.max(initial=0))):
            self.predict(np.flatnonzero(ahead > k))
        n = len(now["frame"])
        strong = now["confidence"] >= s.high
        weak = (now["confidence"] >= s.low) & ~strong
        owner, taken = np.full(n, -1), np.zeros(len(t["group"]), bool)

        def take(j: np.ndarray, places: np.ndarray) -> None:
            a, b = self._match(np.flatnonzero(~taken), j, now, places, gate)
            owner[b], taken[a] = a, True
            self._update(a, b, now)

        take(np.flatnonzero(strong), t["x"][:, :2])
        take(np.flatnonzero(weak), t["x"][:, :2])
        rest = np.flatnonzero((strong | weak) & (owner < 0))
        take(rest[np.lexsort((rest, ~strong[rest], now["group"][rest]))], t["seen"][:, 0])
        fresh = np.flatnonzero(strong & (owner < 0))
        if len(fresh):
            new, g = self._empty(len(fresh)), now["group"][fresh]
            new["group"], new["frame"], new["kind"] = g, now["frame"][fresh], now["kind"][fresh]
            new["ident"] = self.next[g] + np.arange(len(g)) - np.searchsorted(g, g)
            self.next += np.bincount(g, minlength=len(self.next))
            new["x"][:, :2] = new["seen"][:, 0] = now["z"][fresh]
            new["p"][:] = np.diag([1.0, 1.0, s.start_speed**2, s.start_speed**2])
            new["hits"][:] = new["kept"][:] = 1
            new["link"][:] = -1
            owner[fresh] = len(taken) + np.arange(len(fresh))
            self.state = t = {c: np.concatenate([t[c], new[c]]) for c in t}
            self._on_lane(owner[fresh], now["z"][fresh])
            self._mark(owner[fresh])
        told = owner >= 0
        at = owner[told]
        out = np.zeros(n, np.int64)
        out[told] = np.where((t["hits"][at] >= s.min_hits) | (t["age"][at] <= s.min_hits), t["ident"][at], 0)
        live = np.flatnonzero(t["missed"] <= s.max_age)
        live = live[np.argsort(t["group"][live], kind="stable")]
        self.state = {c: v[live] for c, v in t.items()}
        return out

    def leave(self, gone: np.ndarray) -> None:
        """Forgets the tracks of cameras that have no more frames."""
        stay = ~gone[self.state["group"]]
        self.state = {c: v[stay] for c, v in self.state.items()}


def track_groups(group: np.ndarray, rows: dict[str, np.ndarray], dt: float, settings: Settings, lanes: Lanes | None, gate: float, going: tuple[Fleet, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Track numbers, 0 for none, of rows (frame, z, r, known, confidence, kind) that lie by group, frame.

    going: a fleet, the last frame of each group, and whether it had one; all three go on from there and stay.
    """
    frame = rows["frame"]
    if not len(frame):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    tick = new | np.concatenate([[True], frame[1:] != frame[:-1]])
    first = np.maximum.accumulate(np.where(new, np.cumsum(tick), 0))
    turn = np.cumsum(tick) - first  # the number of the row's frame in its group
    groups = int(group.max()) + 1 if going is None else len(going[1])
    fleet, last, seen = going or (Fleet(groups, dt, settings, lanes), np.zeros(groups, np.int64), np.zeros(groups, bool))
    out, ends = np.zeros(len(frame), np.int64), np.zeros(groups, np.int64)
    np.maximum.at(ends, group, turn)
    order = np.argsort(turn, kind="stable")
    for k, some in enumerate(np.split(order, np.flatnonzero(np.diff(turn[order])) + 1)):
        g, f = group[some], frame[some]
        steps = np.zeros(groups, np.int64)
        steps[g] = np.where(seen[g], np.maximum(1, f - last[g]), 1)
        out[some] = fleet.step({"group": g} | {c: v[some] for c, v in rows.items()}, steps, gate)
        last[g], seen[g] = f, True
        if going is None and (ends == k).any():
            fleet.leave(ends <= k)
    return out

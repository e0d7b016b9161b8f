"""The graph of lanes: topology, gaps between links, positions along links."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import shortest
from .spatial_join import within_distance

#: Links end and begin at one junction within this distance; gaps are looked for up to LIMIT metres; a step back of BACK metres on one link is noise.
JUNCTION_M, LIMIT_M, BACK_M = 3.0, 300.0, 1.0


def ends(links: DataFrame) -> DataFrame:
    """Rows (link_id, directed, from_node, to_node, length, ax, ay, bx, by): first and last point.  Maps without nodes have nulls there."""
    p = F.col("pts")
    links = links.select("link_id", "directed", "pts", *(c if c in links.columns else F.lit(None).cast("string").alias(c) for c in ("from_node", "to_node")))
    steps = F.zip_with(F.expr("slice(pts, 1, size(pts) - 1)"), F.expr("slice(pts, 2, size(pts) - 1)"), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    length = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)
    return links.where("size(pts) >= 2").select("link_id", "directed", "from_node", "to_node", length.alias("length"), p[0]["x"].alias("ax"), p[0]["y"].alias("ay"), F.element_at(p, -1)["x"].alias("bx"), F.element_at(p, -1)["y"].alias("by"))


def by_nodes(e: DataFrame) -> DataFrame:
    """Edges (src, dst) where a link ends in the node that another begins in."""
    out = e.where("to_node is not null").select(F.col("link_id").alias("src"), F.col("to_node").alias("node"))
    into = e.where("from_node is not null").select(F.col("link_id").alias("dst"), F.col("from_node").alias("node"))
    return out.join(into, "node").where("src <> dst").select("src", "dst").distinct()


def by_distance(e: DataFrame, metres: float = JUNCTION_M) -> DataFrame:
    """Edges (src, dst) where a link ends within `metres` of another's beginning."""
    last = e.select(F.col("link_id").alias("src"), F.col("bx").alias("x"), F.col("by").alias("y"))
    first = e.select(F.col("link_id").alias("dst"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    return within_distance(last, first, metres).where("src <> r_dst").select("src", F.col("r_dst").alias("dst")).distinct()


def topology(links: DataFrame, metres: float = JUNCTION_M) -> DataFrame:
    """Edges (src, dst): by nodes where half the links have them, else by distance; links without direction also run back."""
    e = ends(links)
    known, n = e.agg(F.count_if(F.col("from_node").isNotNull() & F.col("to_node").isNotNull()), F.count(F.lit(1))).first()
    edges = by_nodes(e) if n and 2 * known >= n else by_distance(e, metres)
    two_way = e.where(~F.coalesce("directed", F.lit(True))).select(F.col("link_id").alias("src"))
    back = edges.join(two_way, "src", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.unionByName(back).dropDuplicates(["src", "dst"])


def gaps(edges: DataFrame, lengths: DataFrame, limit: float = LIMIT_M) -> DataFrame:
    """Rows (src, dst, gap): metres between the end of one link and the start of another, through whole links only; 0 to a successor and to itself.

    lengths has link_id and length.  A step costs the length of the link it
    leaves, unless that is the first.
    """
    cost = lengths.select(F.col("link_id").alias("src"), F.col("length").alias("cost"))
    priced = edges.join(cost, "src").select("src", "dst", "cost")
    within = shortest(priced.where(F.col("cost") <= limit), limit)
    # from a successor of the first link on, every link that is left counts
    far = edges.select(F.col("src").alias("first"), F.col("dst").alias("src")).join(within, "src").select(F.col("first").alias("src"), "dst", F.col("cost").alias("gap"))
    near = edges.select("src", "dst", F.lit(0.0).alias("gap"))
    own = lengths.select(F.col("link_id").alias("src"), F.col("link_id").alias("dst"), F.lit(0.0).alias("gap"))
    return far.unionByName(near).unionByName(own).where(F.col("gap") <= limit).groupBy("src", "dst").agg(F.min("gap").alias("gap"))


def route_distance(pairs: DataFrame, gap: DataFrame, lengths: DataFrame) -> DataFrame:
    """`pairs` (link_a, s_a, link_b, s_b) with route: metres along the graph, null if out of reach.

    The gap between the links is limited (see `gaps`), the way to the end of the
    first and from the start of the last is not.  On one link a step back of up
    to BACK_M counts with its size; farther back is out of reach unless the
    graph leads round.
    """
    g = gap.where("src <> dst").select(F.col("src").alias("link_a"), F.col("dst").alias("link_b"), "gap")
    rows = pairs.join(g, ["link_a", "link_b"], "left").join(lengths.select(F.col("link_id").alias("link_a"), "length"), "link_a", "left")
    ahead = F.col("s_b") - F.col("s_a")
    same = F.when(ahead >= -BACK_M, F.abs(ahead))
    through = F.greatest(F.lit(0.0), F.col("length") - F.col("s_a")) + F.col("gap") + F.col("s_b")
    route = F.when(F.col("link_a") == F.col("link_b"), same).otherwise(through)
    return rows.withColumn("route", route).drop("gap", "length")


def flip_by_node(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose last point is nearer their from_node (node_id, x, y) than the first have their points reversed."""
    n = nodes.select(F.col("node_id").alias("from_node"), F.col("x").alias("_nx"), F.col("y").alias("_ny"))
    rows = links.join(n, "from_node", "left")
    first, last = F.col("pts")[0], F.element_at(F.col("pts"), -1)
    wrong = F.hypot(last["x"] - F.col("_nx"), last["y"] - F.col("_ny")) < F.hypot(first["x"] - F.col("_nx"), first["y"] - F.col("_ny"))
    return rows.withColumn("flipped", F.coalesce(wrong, F.lit(False))).withColumn("pts", F.when(F.col("flipped"), F.reverse("pts")).otherwise(F.col("pts"))).drop("_nx", "_ny").select(*links.columns, "flipped")


class Graph:
    """A small graph in memory, for the per-track and per-camera algorithms: the map of one camera's surroundings.

    links: id -> (points [n, 2], directed); successors: id -> ids.
    """

    def __init__(self, links: dict[str, tuple[np.ndarray, bool]], successors: dict[str, list[str]], step: float = 2.0) -> None:
        self.ids = sorted(links)
        self.directed = {k: bool(links[k][1]) for k in self.ids}
        self.successors = {k: [x for x in successors.get(k, []) if x in links] for k in self.ids}
        self.points, self.along = {}, {}
        for k in self.ids:
            p = np.asarray(links[k][0], float)
            s = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
            n = max(2, int(np.ceil(s[-1] / step)) + 1)
            self.along[k] = np.linspace(0.0, s[-1], n)
            self.points[k] = np.column_stack([np.interp(self.along[k], s, p[:, i]) for i in (0, 1)])
        self._gaps: dict[tuple[str, float], dict[str, float]] = {}

    @classmethod
    def from_rows(cls, links: list, edges: list, step: float = 2.0) -> Graph:
        """From collected rows of links and edges."""
        successors: dict[str, list[str]] = {}
        for e in edges:
            successors.setdefault(e.src, []).append(e.dst)
        return cls({r.link_id: (np.array([(p.x, p.y) for p in r.pts]), r.directed) for r in links}, successors, step)

    def length(self, link: str) -> float:
        return float(self.along[link][-1])

    def tangent(self, link: str, s: float) -> np.ndarray:
        """Unit direction of the piece of the link that holds s."""
        a = self.along[link]
        i = int(np.clip(np.searchsorted(a, s), 1, len(a) - 1))
        d = self.points[link][i] - self.points[link][i - 1]
        n = np.hypot(*d)
        return d / n if n else np.array([1.0, 0.0])

    def heading(self, link: str, s: float) -> float:
        t = self.tangent(link, s)
        return float(np.degrees(np.arctan2(t[1], t[0])))

    def at(self, link: str, s: float, d: float = 0.0) -> np.ndarray:
        """Point at s, d to the left."""
        s = float(np.clip(s, 0.0, self.length(link)))
        a, p = self.along[link], self.points[link]
        t = self.tangent(link, s)
        return np.array([np.interp(s, a, p[:, 0]), np.interp(s, a, p[:, 1])]) + d * np.array([-t[1], t[0]])

    def onto(self, link: str, point) -> tuple[float, float, float]:
        """(s, d, distance) of the nearest point of the link."""
        p, a = self.points[link], self.along[link]
        v = np.diff(p, axis=0)
        n = np.maximum((v**2).sum(1), 1e-12)
        q = np.asarray(point, float)
        t = np.clip(((q - p[:-1]) * v).sum(1) / n, 0.0, 1.0)
        foot = p[:-1] + t[:, None] * v
        r = np.hypot(*(q - foot).T)
        i = int(np.argmin(r))
        s = float(a[i] + t[i] * (a[i + 1] - a[i]))
        w = self.tangent(link, s)
        return s, float((q - foot[i]) @ np.array([-w[1], w[0]])), float(r[i])

    def near(self, point, distance: float = 25.0, k: int = 6) -> list[tuple[str, float, float, float]]:
        """(link, s, d, distance) of up to k links within reach, least |d| first."""
        out = [(link, *self.onto(link, point)) for link in self.ids]
        return sorted((c for c in out if c[3] <= distance), key=lambda c: (abs(c[2]), c[0]))[:k]

    def gap(self, a: str, b: str, limit: float = LIMIT_M) -> float | None:
        """Metres between the end of a and the start of b; None out of reach."""
        if a == b:
            return 0.0
        if (a, limit) not in self._gaps:
            best: dict[str, float] = {}
            heap = [(0.0, x) for x in self.successors[a]]
            heapq.heapify(heap)
            while heap:
                cost, link = heapq.heappop(heap)
                if link in best:
                    continue
                best[link] = cost
                through = cost + self.length(link)
                if through <= limit:
                    for x in self.successors[link]:
                        if x not in best:
                            heapq.heappush(heap, (through, x))
            self._gaps[a, limit] = best
        return self._gaps[a, limit].get(b)

    def route(self, a: tuple[str, float], b: tuple[str, float], limit: float = LIMIT_M) -> float | None:
        """Metres from (link, s) to (link, s), the gap between the links within `limit`."""
        if a[0] == b[0]:
            ahead = b[1] - a[1]
            return abs(ahead) if ahead >= -BACK_M else None
        g = self.gap(a[0], b[0], limit)
        if g is None:
            return None
        return max(0.0, self.length(a[0]) - a[1]) + g + b[1]

    def advance(self, link: str, s: float, ds: float, toward: np.ndarray | None = None, most: int = 8) -> tuple[str, float]:
        """(link, s) after ds metres, over at most `most` links, each time the straightest successor (or the one most toward a direction); a way back ends with the link."""
        s += ds
        for _ in range(most if ds > 0 else 0):
            if s <= self.length(link) or not self.successors[link]:
                break
            t = self.tangent(link, self.length(link)) if toward is None else toward
            s -= self.length(link)
            link = max(self.successors[link], key=lambda x: (float(self.tangent(x, 0.0) @ t), x))
        return link, float(np.clip(s, 0.0, self.length(link)))

"""Matching tracks to lanes: greedy, Viterbi, locking to a chain of links, snapping to lane centres."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import long_tracks
from .graph import cut
from .lane_graph import BACK_M, LIMIT_M, ends, gaps, topology
from .long_tracks import backward, forward, whole
from .sequences import deal, grid, lists, whole_groups, whole_pairs, with_column
from .spatial_join import candidates, project_onto

# Noise across the lane and along routes in metres, reach, links kept, weight of a wrong direction, least speed whose heading is trusted.
SIGMA, BETA, REACH, KEEP, WEIGHT, TRUST_KMH = 2.0, 4.0, 25.0, 6, 2.0, 5.0
STATE = "link_id string, s double, d double"
#: Frames of a track that one task handles; longer tracks are many tasks.
CHUNK = 20_000
#: Pairs of lists of options up to which their gaps are sent to all tasks.
FEW = 20_000
#: Pairs of a row and a piece of its chain that are held at once.
PAIRS = 1_000_000


def isotonic(y: np.ndarray) -> np.ndarray:
    """Nearest non-decreasing sequence in squares: neighbours that fall are pooled into their mean."""
    return np.repeat(*long_tracks.pools(y))


def smooth_progress(s: np.ndarray, width: int = 9) -> np.ndarray:
    """Positions with a smoothed speed: steps clipped at 0, averaged over an odd width with held ends, scaled to the same distance."""
    s = np.asarray(s, float)
    if len(s) < 3:
        return s.copy()
    step = np.clip(np.diff(s), 0.0, None)
    width = max(3, width | 1)
    # a sum of `width` steps around, those beyond the ends being the first and the last
    held = np.arange(-(width // 2), len(step) + width // 2).clip(0, len(step) - 1)
    total = np.concatenate([[0.0], np.cumsum(step[held])])
    smooth = (total[width:] - total[:-width]) / width
    if step.sum() > 1e-9 and smooth.sum() > 1e-9:
        smooth *= step.sum() / smooth.sum()
    return s[0] + np.concatenate([[0.0], np.cumsum(smooth)])


def _along(rows: DataFrame, by: list[str], order: str, value: str, smooth) -> DataFrame:
    """`rows` with `value` replaced by what `smooth` makes of a track's values in order."""

    def run(tracks, starts: np.ndarray):
        values = tracks[value].to_numpy()
        return with_column(tracks, value, np.concatenate([smooth(v) for v in np.split(values, starts[1:])]))

    return whole_groups(rows, by, [order], run, rows.schema)


def _any_length(rows: DataFrame, by: list[str], order: str, chunk: float | None, short, long) -> DataFrame:
    """`short` of the tracks of at most `chunk` rows or within one stretch of `chunk` (all if that is None), `long` of the others."""
    if chunk is None:
        return short(rows)
    parted = rows.withColumn("_chunk", long_tracks.chunked(order, chunk))
    spans = parted.groupBy(*by).agg(((F.min("_chunk") < F.max("_chunk")) & (F.count(F.lit(1)) > chunk)).alias("_several"))
    if not spans.where("_several").limit(1).count():
        return short(rows)
    told = long_tracks.joined(parted, spans, by)
    return short(told.where("_several is null or not _several").select(*rows.columns)).unionByName(long(told.where("_several").drop("_several")).select(*rows.columns))


def monotone(rows: DataFrame, by: list[str], order: str, value: str, chunk: float | None = CHUNK) -> DataFrame:
    """`rows` with `value` (a double) made non-decreasing along each track, see `isotonic`.

    A track of more than `chunk` rows that spans more than one stretch of `chunk` of its order is handled in stretches.
    """
    return _any_length(rows, by, order, chunk, lambda r: _along(r, by, order, value, isotonic), lambda r: long_tracks.monotone(r, by, order, value))


def progress(rows: DataFrame, by: list[str], order: str, value: str, width: int = 9, chunk: float | None = CHUNK) -> DataFrame:
    """`rows` with positions (a double) of a smoothed speed along each track, see `smooth_progress`.

    A track of more than `chunk` rows that spans more than one stretch of `chunk` of its order is handled in stretches.
    """
    return _any_length(rows, by, order, chunk, lambda r: _along(r, by, order, value, lambda s: smooth_progress(s, width)), lambda r: long_tracks.progress(r, by, order, value, max(3, width | 1)))


def smooth_lateral(d: np.ndarray, width: int = 5) -> np.ndarray:
    """Median of the values around, fewer at the ends."""
    half = width // 2
    return np.array([np.median(d[max(0, i - half) : i + half + 1]) for i in range(len(d))])


def directions(rows: DataFrame, by: list[str], trust_kmh: float = TRUST_KMH) -> DataFrame:
    """`rows` with _dir in radians: the row's own heading if it moves, else the mean heading of the track's moving rows, else null."""
    moving = F.col("heading").isNotNull() & ~F.isnan("heading") & (F.coalesce("speed_kmh", F.lit(0.0)) >= trust_kmh)
    track = Window.partitionBy(*by)
    east, north = (F.sum(F.when(moving, f(F.radians("heading")))).over(track) for f in (F.cos, F.sin))
    mean = F.when(F.hypot("_east", "_north") > 1e-9, F.atan2("_north", "_east"))
    return rows.withColumns({"_east": east, "_north": north}).withColumn("_dir", F.when(moving, F.radians("heading")).otherwise(mean)).drop("_east", "_north")


def wrongness(bearing: Column, direction: Column, directed: Column) -> Column:
    """0 along the lane, 1 against it (across it, where the lane has no direction); 0 without a direction.  bearing in degrees, direction in radians."""
    c = F.cos(F.radians(bearing) - direction)
    return F.coalesce(F.when(F.coalesce(directed, F.lit(True)), (1.0 - c) / 2.0).otherwise((1.0 - F.abs(c)) / 2.0), F.lit(0.0))


def with_options(rows: DataFrame, links: DataFrame, reach: float = REACH, k: int = KEEP) -> DataFrame:
    """`rows` (x, y) with options: up to k links in reach, least |d| first (to nine digits, so that links in line keep their order), as structs (near, link_id, s, d, bearing, directed, length); null where there are none.

    Each place is looked up once, however many rows stand on it.
    """
    places = rows.where("x is not null and y is not null").select("x", "y").distinct().withColumn("_place", F.struct("x", "y"))
    about = ends(links).select("link_id", "directed", "length")
    found = candidates(places, links, "_place", reach, k).join(about, "link_id")
    listed = found.groupBy("_place").agg(F.sort_array(F.collect_list(F.struct(F.round(F.abs("d"), 9).alias("near"), "link_id", "s", "d", "bearing", "directed", "length"))).alias("options"))
    return rows.join(listed.select("_place.x", "_place.y", "options"), ["x", "y"], "left")


def greedy(rows: DataFrame, links: DataFrame, by: list[str], *, reach: float = REACH, k: int = KEEP, weight: float = 8.0, trust_kmh: float = TRUST_KMH) -> DataFrame:
    """`rows` with link_id, s, d: of the links in reach, that with the least |d| plus weighted wrongness of direction, each row on its own; nulls without a link."""
    options = with_options(directions(rows.drop("link_id", "s", "d"), by, trust_kmh), links, reach, k)
    cost = F.transform("options", lambda o: F.struct(F.round(F.abs(o["d"]) + weight * wrongness(o["bearing"], F.col("_dir"), o["directed"]), 9).alias("cost"), o["link_id"].alias("link_id"), o["s"].alias("s"), o["d"].alias("d")))
    return options.withColumn("_best", F.array_min(cost)).select(*(c for c in rows.columns if c not in ("link_id", "s", "d")), "_best.link_id", "_best.s", "_best.d")


def _ways(rows: DataFrame, links: DataFrame, by: list[str], reach: DataFrame) -> DataFrame:
    """Rows (by, src, dst, gap, px, py): for each track the gaps (`reach`) between links that follow each other among its options _link_id, and the points of its links on rows where src = dst."""
    before = Window.partitionBy(*by).orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    steps = rows.where("_link_id is not null").select(*by, "frame", F.col("_link_id").alias("_to"))
    steps = steps.withColumn("_from", F.last("_to").over(before)).select(*by, "_from", "_to").distinct()
    pairs = steps.where("_from is not null").withColumn("src", F.explode("_from")).withColumn("dst", F.explode("_to")).where("src <> dst").select(*by, "src", "dst").distinct()
    none = F.lit(None).cast("array<double>")
    routes = pairs.join(reach, ["src", "dst"]).select(*by, "src", "dst", "gap", none.alias("px"), none.alias("py"))
    own = steps.select(*by, F.explode("_to").alias("link_id")).distinct().join(links.select("link_id", "pts"), "link_id")
    return routes.unionByName(own.select(*by, F.col("link_id").alias("src"), F.col("link_id").alias("dst"), F.lit(0.0).alias("gap"), F.col("pts.x").alias("px"), F.col("pts.y").alias("py")))


class Ways:
    """The links that one track may be on, numbered: the gaps between them and their points."""

    def __init__(self, src: list, dst: list, gap: np.ndarray, px: list, py: list) -> None:
        self.ids = sorted({a for a, b in zip(src, dst, strict=True) if a == b})
        self.code = {link: k for k, link in enumerate(self.ids)}
        n = len(self.ids)
        at = {a: k for k, (a, b) in enumerate(zip(src, dst, strict=True)) if a == b}
        self.points = [np.column_stack([np.asarray(px[at[link]], float), np.asarray(py[at[link]], float)]) for link in self.ids]
        self.length = np.array([np.hypot(*np.diff(p, axis=0).T).sum() for p in self.points])
        key = np.array([self.code[a] * n + self.code[b] for a, b in zip(src, dst, strict=True)], np.int64)
        order = np.argsort(key)
        self._key, self._gap = key[order], np.asarray(gap, float)[order]

    def gap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Metres between the end of a and the start of b, by numbers of links; infinite out of reach."""
        want = np.asarray(a, np.int64) * len(self.ids) + b
        at = np.searchsorted(self._key, want).clip(0, len(self._key) - 1)
        return np.where(self._key[at] == want, self._gap[at], np.inf)

    def onto(self, link: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(s, d, distance) of the nearest place on a link for each point."""
        p = self.points[link]
        v = np.diff(p, axis=0)
        w = np.hypot(*v.T)
        q = points[:, None, :] - p[None, :-1]
        t = ((q * v).sum(2) / np.maximum(w**2, 1e-12)).clip(0.0, 1.0)
        off = q - t[:, :, None] * v
        r = np.hypot(off[..., 0], off[..., 1])
        i = np.argmin(r, axis=1)
        row = np.arange(len(points))
        s = np.concatenate([[0.0], np.cumsum(w)])[i] + t[row, i] * w[i]
        n = v[i] / np.maximum(w[i], 1e-12)[:, None]
        o = off[row, i]
        return s, n[:, 0] * o[:, 1] - n[:, 1] * o[:, 0], r[row, i]


def moves(ways: Ways, points: np.ndarray, link: np.ndarray, s: np.ndarray, beta: float = BETA) -> np.ndarray:
    """Scores [n - 1, k, k], as whole numbers, of the steps between the options of a point and of the next: exponential in the difference of straight and route distance; no route, no step."""
    straight = np.hypot(*np.diff(points, axis=0).T)[:, None, None]
    a, b, sa, sb = link[:-1, :, None], link[1:, None, :], s[:-1, :, None], s[1:, None, :]
    ahead = sb - sa
    route = np.maximum(0.0, ways.length[a] - sa) + ways.gap(a, b) + sb
    route = np.where(a == b, np.where(ahead >= -BACK_M, np.abs(ahead), np.inf), route)
    return whole(np.where((a < 0) | (b < 0) | ~np.isfinite(route), -np.inf, -np.abs(straight - np.where(np.isfinite(route), route, 0.0)) / beta - np.log(beta)))


def viterbi(ways: Ways, points: np.ndarray, link: np.ndarray, s: np.ndarray, emit: np.ndarray, *, beta: float = BETA) -> np.ndarray:
    """Which option of each point lies on the most likely path.

    link, s and emit hold the options of a point in a row, -1 and -inf standing
    for none.  If no step is left the path begins anew.  Scores are rounded to
    millionths; of equal ones the first option counts.
    """
    if not len(link):
        return np.zeros(0, int)
    emit = whole(emit)
    scores, back = forward(emit[0], emit, moves(ways, points, link, s, beta))
    return backward(scores, back, int(np.argmax(scores[-1])))


def lane_lock(ways: Ways, points: np.ndarray, link: np.ndarray, s: np.ndarray, d: np.ndarray, width: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(link, s, d) on the longest connected chain of the links passed, with positions that never fall back and a smoothed speed."""
    if len(link) < 2:
        return link, s, d
    passed = link[np.concatenate([[True], link[1:] != link[:-1]])]
    cuts = np.flatnonzero(~np.isfinite(ways.gap(passed[:-1], passed[1:]))) + 1
    chain = list(dict.fromkeys(max(np.split(passed, cuts), key=len).tolist()))
    offset = np.concatenate([[0.0], np.cumsum(ways.length[chain])])
    feet = [ways.onto(x, points) for x in chain]
    lateral, away = np.array([f[1] for f in feet]), np.array([f[2] for f in feet])
    # the least lateral offset; of links in line, which share it, the nearest
    best = np.lexsort((away, np.abs(lateral).round(6)), axis=0)[0]
    row = np.arange(len(points))
    along = smooth_progress(isotonic(offset[best] + np.array([f[0] for f in feet])[best, row]), width)
    # to nine digits, so that the last bit doesn't move a row over a junction
    at = np.searchsorted(offset[1:-1].round(9), along.round(9), side="left")
    return np.array(chain)[at], (along - offset[at]).clip(0.0, ways.length[chain][at]), lateral[best, row]


class _Options:
    """The rows of a track, or of a stretch of it, that have options: their places, and the options as grids of `k` columns."""

    def __init__(self, track, known, k: int) -> None:
        lists = track.column("_link_id").combine_chunks()
        size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
        size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), size, 0)
        self.seen = np.flatnonzero(size)
        if not len(self.seen):
            return
        self.ways = Ways(*(known.column(c).to_pylist() for c in ("src", "dst", "gap", "px", "py")))
        filled = np.arange(k) < size[self.seen][:, None]
        grid = []
        for c, empty in (("_link_id", -1), ("_s", 0.0), ("_d", 0.0), ("_emit", -np.inf)):
            values = track.column(c).combine_chunks().flatten()
            values = np.array([self.ways.code[v] for v in values.to_pylist()]) if c == "_link_id" else values.to_numpy(zero_copy_only=False)
            some = np.full(filled.shape, empty, values.dtype)
            some[filled] = values
            grid.append(some)
        self.link, self.s, self.d, self.emit = grid
        self.points = np.column_stack([track.column(c).to_numpy() for c in ("x", "y")]).astype(float)[self.seen]


def match_tracks(rows: DataFrame, links: DataFrame, by: list[str], method: str = "lock", *, edges: DataFrame | None = None, sigma: float = SIGMA, beta: float = BETA, reach: float = REACH, k: int = KEEP, limit: float = LIMIT_M, weight: float = WEIGHT, trust_kmh: float = TRUST_KMH, chunk: int | None = CHUNK) -> DataFrame:
    """`rows` (by, frame, x, y, heading, speed_kmh) with link_id, s, d; nulls where no link is in reach.

    method: `viterbi`, the most likely path (emission: Gauss in d, less the
    weighted wrongness of direction), or `lock`, that path kept to its longest
    chain; `greedy` needs no path, see there.  Links are found by cells and
    routes by joins of the whole map.  A track within `chunk` frames is one
    task, which gets its own rows, their options and the gaps between them only;
    a longer one is cut in stretches of `chunk` frames (None: never), which are
    dealt over tasks, with the same result.
    """
    if method == "greedy":
        return greedy(rows, links, by, reach=reach, k=k, trust_kmh=trust_kmh)
    plain = rows.drop("link_id", "s", "d")

    def optioned(told: DataFrame) -> DataFrame:
        options = with_options(told, links, reach, k)
        emit = F.transform("options", lambda o: -0.5 * F.pow(o["d"] / sigma, F.lit(2.0)) - float(np.log(np.sqrt(2 * np.pi) * sigma)) - weight * wrongness(o["bearing"], F.col("_dir"), o["directed"]))
        return options.select(*(c for c in told.columns if c != "_dir"), *(F.col(f"options.{c}").alias(f"_{c}") for c in ("link_id", "s", "d", "length")), emit.alias("_emit"))

    known = gaps(topology(links) if edges is None else edges, ends(links).select("link_id", "length"), limit).where("src <> dst")
    short = lambda r: _whole_tracks(r.drop("_length"), links, by, method, known, beta, k, plain)
    several = lambda least, most: F.floor(least / chunk) < F.floor(most / chunk)
    if chunk is None or not plain.groupBy(*by).agg(several(F.min("frame"), F.max("frame")).alias("_several")).where("_several").limit(1).count():
        return short(optioned(directions(plain, by, trust_kmh)))
    track = Window.partitionBy(*by)
    told = cut(directions(plain, by, trust_kmh).withColumn("_several", several(F.min("frame").over(track), F.max("frame").over(track))))
    told = cut(optioned(told))
    known = cut(known)
    path = _long_paths(told.where("_several").drop("_several").withColumn("_chunk", long_tracks.chunked("frame", chunk)), by, known, beta, k)
    if method == "lock":
        path = _long_locks(cut(path), links, by, known)
    return short(told.where("_several is null or not _several").drop("_several")).unionByName(path.select(*plain.columns, "link_id", "s", "d"))


def _matched(rows: DataFrame, ways: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """`run` on the rows and the ways of each key."""
    # columns of one origin on both sides would be ambiguous
    ways = ways.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    of = [f"_of_{c}" for c in keys]
    return deal(rows, *keys).groupBy(*keys).cogroup(deal(ways, *of).groupBy(*of)).applyInArrow(run, schema)


def _whole_tracks(flat: DataFrame, links: DataFrame, by: list[str], method: str, known: DataFrame, beta: float, k: int, plain: DataFrame) -> DataFrame:
    """Each track in one task."""
    import pyarrow as pa

    columns = plain.columns

    def run(track: pa.Table, near: pa.Table) -> pa.Table:
        track = track.sort_by([(c, "ascending") for c in ("frame", "x", "y")]).combine_chunks()
        out = track.select(columns)
        o = _Options(track, near, k)
        names, s, d = [None] * len(track), [None] * len(track), [None] * len(track)
        if len(o.seen):
            pick = (np.arange(len(o.seen)), viterbi(o.ways, o.points, o.link, o.s, o.emit, beta=beta))
            state = o.link[pick], o.s[pick], o.d[pick]
            if method == "lock":
                state = lane_lock(o.ways, o.points, *state)
            for i, a, b, c in zip(o.seen.tolist(), *(v.tolist() for v in state), strict=True):
                names[i], s[i], d[i] = o.ways.ids[a], b, c
        for name, values, kind in (("link_id", names, pa.string()), ("s", s, pa.float64()), ("d", d, pa.float64())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return _matched(flat, _ways(flat, links, by, known), by, run, f"{fields}, {STATE}")


def _with_leads(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """`rows` (with _chunk and options) and, for each stretch with options but a track's first, the row with options before it: both with _from, the options of the row before, and _lead, which is true for the latter.

    One sort of the rows by stretches; what comes from the stretch before is joined to a stretch's first row only.
    """
    keys = [*by, "_chunk"]
    stretch = Window.partitionBy(*keys).orderBy(*long_tracks.ordered("frame", "x", "y"))
    before, until, whole_ = (stretch.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0, Window.unboundedFollowing))
    seen = F.col("_link_id").isNotNull()
    inner = cut(rows.withColumns({"_from": F.when(seen, F.last("_link_id", True).over(before)), "_end": seen & (F.count("_link_id").over(until) == F.count("_link_id").over(whole_))}))
    behind = F.lead(F.struct("_chunk")).over(Window.partitionBy(*by).orderBy(*long_tracks.ordered("_chunk")))
    leads = cut(inner.where("_end").withColumn("_next", behind).where("_next is not null").withColumn("_chunk", F.col("_next._chunk")).select(*rows.columns))
    first = seen & F.col("_from").isNull()
    firsts = long_tracks.joined(inner.where(first).drop("_from"), leads.select(*keys, F.col("_link_id").alias("_from")), keys, "left")
    led = inner.where(~first).unionByName(firsts).drop("_end").withColumn("_lead", F.lit(False))
    return led, leads.withColumns({"_from": F.lit(None).cast(led.schema["_from"].dataType), "_lead": F.lit(True)})


def _with_gaps(led: DataFrame, known: DataFrame) -> DataFrame:
    """`led` with _gap: metres between each option of the row before and each of its own, in their order, -1 for the same link.

    Rows of many tracks have the same options, so each pair of lists is looked up once.
    """
    pairs = led.where("_from is not null").select("_from", F.col("_link_id").alias("_to")).distinct()
    cells = pairs.select("*", F.posexplode("_from").alias("_i", "src")).select("*", F.posexplode("_to").alias("_j", "dst")).join(known, ["src", "dst"], "left")
    gap = F.when(F.col("src") == F.col("dst"), F.lit(-1.0)).otherwise(F.coalesce("gap", F.lit(float("inf"))))
    listed = cells.groupBy("_from", "_to").agg(F.sort_array(F.collect_list(F.struct("_i", "_j", gap.alias("gap")))).alias("_cells"))
    listed = cut(listed.select(F.col("_from").alias("_a"), F.col("_to").alias("_b"), F.col("_cells.gap").alias("_gap")))
    near = F.broadcast(listed) if listed.count() <= FEW else listed
    return led.join(near, (F.col("_from") == F.col("_a")) & (F.col("_link_id") == F.col("_b")), "left").drop("_from", "_a", "_b")


class _Stretches:
    """Rows with options of many stretches that lie one after the other, `n` rows each."""

    def __init__(self, part, n: np.ndarray, k: int, beta: float) -> None:
        (s, size), (length, _), (emit, _) = (grid(part[c], k, empty, float) for c, empty in (("_s", 0.0), ("_length", 0.0), ("_emit", -np.inf)))
        self.seen = np.flatnonzero(size)
        #: how many rows with options each stretch has; of those that have some: their numbers, and where their rows begin
        self.many = np.bincount(np.repeat(np.arange(len(n)), n)[self.seen], minlength=len(n))
        self.some = np.flatnonzero(self.many)
        self.size = self.many[self.some]
        self.first = np.cumsum(self.size) - self.size
        lead = part["_lead"].to_numpy()[self.seen[self.first]].astype(bool)
        self.led, self.emit = lead, whole(emit[self.seen])
        s, length, size = s[self.seen], length[self.seen], size[self.seen]
        points = np.column_stack([part[c].to_numpy() for c in ("x", "y")]).astype(float)[self.seen]
        inner = np.ones(len(size), bool)
        inner[self.first] = False
        was = np.where(inner, np.arange(len(size)) - 1, 0)
        filled = (np.arange(k)[:, None] < np.where(inner, size[was], 0)[:, None, None]) & (np.arange(k) < size[:, None, None])
        gap = np.full(filled.shape, np.inf)
        gap[filled] = part["_gap"].combine_chunks().flatten().to_numpy()
        straight = np.hypot(*(points - points[was]).T)[:, None, None]
        ahead = s[:, None, :] - s[was][:, :, None]
        route = np.maximum(0.0, length[was] - s[was])[:, :, None] + gap + s[:, None, :]
        route = np.where(filled & (gap < 0), np.where(ahead >= -BACK_M, np.abs(ahead), np.inf), route)
        self.move = whole(np.where(~np.isfinite(route), -np.inf, -np.abs(straight - np.where(np.isfinite(route), route, 0.0)) / beta - np.log(beta)))


def _long_paths(rows: DataFrame, by: list[str], known: DataFrame, beta: float, k: int) -> DataFrame:
    """`rows` (with _chunk and options) with link_id, s, d of the most likely path, see `long_tracks`.

    Also _was, the link of the row with one before in the stretch, and whether a row is the stretch's first (_begins) or last (_ends) with a link.
    """
    import pyarrow as pa

    keys, order = [*by, "_chunk"], ["frame", "x", "y"]
    kinds = long_tracks.kinds_of(rows, keys)
    own, leads = _with_leads(rows, by)
    led = _with_gaps(own.unionByName(leads), known)

    def summary(part: pa.Table, first: np.ndarray) -> pa.Table:
        o = _Stretches(part, np.diff([*first, len(part)]), k, beta)
        out = part.select(keys).take(first)
        begins, goes = (np.isin(np.arange(len(first)), o.some[w]) for w in (~o.led, o.led))
        scores, _ = long_tracks.forwards(o.emit[o.first], o.emit, o.move, o.first, np.where(o.led, 1, o.size))
        state, dies = long_tracks.passages(o.emit, o.move, o.first[o.led], o.size[o.led])
        last = o.first + o.size - 1
        for name, values, some, width in (("start", scores[last[~o.led]], begins, k), ("state", state, goes, k * k), ("dies", dies, goes, k)):
            out = out.append_column(name, lists(values.ravel().astype(np.int64), some * width, some))
        return out

    needed = [*keys, *order, "_lead", "_s", "_length", "_emit", "_gap"]
    numbers = ", ".join(f"{c} array<long>" for c in ("start", "state", "dies"))
    entries = cut(long_tracks.entries(whole_groups(led.select(*needed), keys, order, summary, f"{kinds}, {numbers}"), by, k))
    kept = [c for c in led.columns if c not in ("_emit", "_length", "_gap")]

    def paths(part: pa.Table, n: np.ndarray, of: pa.Table, m: np.ndarray) -> pa.Table:
        o = _Stretches(part, n, k, beta)
        entry, _ = grid(of["entry"], k, long_tracks.NONE, np.int64)
        start = np.where(o.led[:, None], entry[o.some], o.emit[o.first])
        scores, back = long_tracks.forwards(start, o.emit, o.move, o.first, o.size)
        picks = long_tracks.backwards(scores, back, np.arange(k)[None].repeat(len(o.size), axis=0), o.first, o.size)
        # an option that is not reached has no path
        picks[np.repeat(scores[o.first + o.size - 1], o.size, axis=0) == long_tracks.NONE] = 0
        some = np.isin(np.arange(len(part)), o.seen)
        return part.select(kept).append_column("_picks", lists(picks.ravel(), some * k, some))

    picked = cut(whole_pairs(led, entries.select(*keys, "entry"), keys, order, [], paths, f"{long_tracks.kinds_of(led, kept)}, _picks array<long>"))
    to = picked.where("_lead").select(*keys, F.col("_picks").alias("to"))
    exits = cut(long_tracks.exits(long_tracks.joined(entries.select(*keys, "last"), to, keys, "left"), by, k))
    columns = [c for c in rows.columns if c not in ("_link_id", "_s", "_d", "_length", "_emit")]

    def chosen(part: pa.Table, n: np.ndarray, of: pa.Table, m: np.ndarray) -> pa.Table:
        picks, size = grid(part["_picks"], k, -1, np.int64)
        leaves = np.repeat(of["exit"].fill_null(-1).to_numpy(), n)
        some = np.flatnonzero((size > 0) & (leaves >= 0))
        _, options = grid(part["_s"], k, 0.0, float)
        at = (np.cumsum(options) - options)[some] + picks[some, leaves[some]]
        rows_ = np.full(len(part), -1)
        rows_[some] = at
        at = pa.array(rows_, mask=rows_ < 0)
        out = part.select(columns)
        for c in ("link_id", "s", "d"):
            out = out.append_column(c, part[f"_{c}"].combine_chunks().flatten().take(at))
        new = _first(np.repeat(np.arange(len(n)), n)[some])
        was, begins, ends_ = np.full(len(part), -1), np.zeros(len(part), bool), np.zeros(len(part), bool)
        was[some[~new]] = some[np.flatnonzero(~new) - 1]
        begins[some], ends_[some] = new, np.concatenate([new[1:], [True]])[: len(some)]
        out = out.append_column("_was", out["link_id"].combine_chunks().take(pa.array(was, mask=was < 0)))
        return out.append_column("_begins", pa.array(begins)).append_column("_ends", pa.array(ends_))

    options = ["_picks", *(f"_{c}" for c in ("link_id", "s", "d"))]
    return whole_pairs(picked.where("not _lead").select(*columns, *options), exits, keys, order, [], chosen, f"{long_tracks.kinds_of(rows, columns)}, {STATE}, _was string, _begins boolean, _ends boolean")


class _Chains:
    """The pieces of the chains of many stretches; `near` lies stretch by stretch in the order of the chain, `m` links each."""

    def __init__(self, near, m: np.ndarray) -> None:
        self.offset, self.length = near["offset"].to_numpy(), near["length"].to_numpy()
        px, py = (near[c].combine_chunks() for c in ("px", "py"))
        x, y, ends = px.flatten().to_numpy(), py.flatten().to_numpy(), px.offsets.to_numpy()
        link = np.repeat(np.arange(len(px)), np.diff(ends))
        piece = np.flatnonzero(link[1:] == link[:-1])
        self.a, self.v = np.column_stack([x, y])[piece], np.column_stack([np.diff(x), np.diff(y)])[piece]
        self.link, self.wide = link[piece], np.hypot(*self.v.T)
        new = np.concatenate([[True], self.link[1:] != self.link[:-1]])
        total = [np.concatenate([[0.0], np.cumsum(w)[:-1]]) for w in np.split(self.wide, np.flatnonzero(new)[1:])]
        self.before = np.concatenate(total)
        # where the pieces of a stretch's chain begin, and how many there are
        self.many = np.bincount(np.repeat(np.arange(len(m)), m)[self.link], minlength=len(m))
        self.first = np.cumsum(self.many) - self.many

    def nearest(self, points: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(along, lateral) of the place on its stretch's chain for each point: the least lateral offset; of links in line, which share it, the nearest."""
        many = self.many[stretch]
        row = np.repeat(np.arange(len(points)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[stretch], many)
        v, w, q = self.v[at], self.wide[at], points[row] - self.a[at]
        t = ((q * v).sum(axis=1) / np.maximum(w**2, 1e-12)).clip(0.0, 1.0)
        off = q - t[:, None] * v
        away = np.hypot(off[:, 0], off[:, 1])
        n = v / np.maximum(w, 1e-12)[:, None]
        lateral, along = n[:, 0] * off[:, 1] - n[:, 1] * off[:, 0], self.before[at] + t * w
        # of the pieces of a link the nearest, then of the links
        order = np.lexsort((away, self.link[at], row))
        order = order[_first(row[order], self.link[at][order])]
        order = order[np.lexsort((away[order], np.abs(lateral[order]).round(6), row[order]))]
        best = order[_first(row[order])]
        return self.offset[self.link[at[best]]] + along[best], lateral[best]


def _first(*columns: np.ndarray) -> np.ndarray:
    """Where the values of sorted columns change."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _long_locks(path: DataFrame, links: DataFrame, by: list[str], known: DataFrame, width: int = 9) -> DataFrame:
    """`path` (see `_long_paths`) kept to the longest chain of each track, as `lane_lock` does.

    Three passes over the rows of stretches: onto the chain, with each stretch's stack of pools; smoothed
    progress of the non-decreasing fit; onto the links.  What joins stretches is made of their stacks.
    """
    import pyarrow as pa

    keys, order, half = [*by, "_chunk"], ["frame", "x", "y"], width // 2
    begins = path.where("_begins")
    carried = path.where("_ends").select(*keys, F.lag("link_id").over(Window.partitionBy(*by).orderBy(*long_tracks.ordered("_chunk"))).alias("_was"))
    starts = long_tracks.joined(begins.select(*keys, "frame", "link_id"), carried, keys)
    passes = path.where("not _begins").select(*keys, "frame", "link_id", "_was").where("_was <> link_id").unionByName(starts.where("_was is null or _was <> link_id")).drop("_chunk")
    routes = known.select(F.col("src").alias("_was"), F.col("dst").alias("link_id"), F.lit(True).alias("_on"))
    # the links passed, one row each: few against a track's rows
    track = Window.partitionBy(*by)
    passes = passes.join(routes, ["_was", "link_id"], "left").withColumn("_piece", F.sum((F.col("_was").isNotNull() & F.col("_on").isNull()).cast("int")).over(track.orderBy("frame")))
    sized = passes.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "_piece")))
    best = sized.withColumn("_best", F.first("_piece").over(track.orderBy(F.desc("_n"), "_piece"))).where("_piece = _best")
    chain = best.groupBy(*by, "link_id").agg(F.min("frame").alias("_at"))
    chain = chain.join(ends(links).select("link_id", "length"), "link_id").join(links.select("link_id", "pts"), "link_id")
    offset = F.coalesce(F.sum("length").over(track.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    chain = cut(chain.select(*by, "_at", "link_id", "length", offset.alias("offset"), F.col("pts.x").alias("px"), F.col("pts.y").alias("py")))
    # a track's only row with a link stays where it is
    marks = ("_was", "_begins", "_ends")
    ones = begins.where("_ends").drop(*marks)
    alone = begins.groupBy(*by).agg((F.count(F.lit(1)) == 1).alias("_alone"))
    ones = long_tracks.joined(ones, alone, by)
    locked = path.where("link_id is not null and not (_begins and _ends)").drop(*marks).unionByName(ones.where("not _alone").drop("_alone"))
    of = cut(long_tracks.joined(begins.select(*keys), chain, by))
    columns = locked.columns
    fields, lying = long_tracks.kinds_of(locked, columns), [*columns, "_along", "_lateral"]

    def project(part: pa.Table, n: np.ndarray, near: pa.Table, m: np.ndarray) -> pa.Table:
        chains = _Chains(near, m)
        points, stretch = np.column_stack([part[c].to_numpy() for c in ("x", "y")]).astype(float), np.repeat(np.arange(len(n)), n)
        # as many rows at a time as have PAIRS pieces to look at
        sliced = np.flatnonzero(np.diff(np.cumsum(chains.many[stretch]) // PAIRS)) + 1
        found = [chains.nearest(p, g) for p, g in zip(np.split(points, sliced), np.split(stretch, sliced), strict=True)]
        along, lateral = (np.concatenate(values) for values in zip(*found, strict=True))
        first = np.cumsum(n) - n
        part = part.select(columns).append_column("_along", pa.array(along)).append_column("_lateral", pa.array(lateral))
        for name, values in zip(("levels", "sizes"), long_tracks.stacks(along, first), strict=True):
            part = part.append_column(name, long_tracks.at_firsts(values, first, len(part)))
        return part

    def smooth(part: pa.Table, n: np.ndarray, near: pa.Table, m: np.ndarray) -> pa.Table:
        along = long_tracks.fitted(near)
        part = with_column(part.select(lying), "_along", along)
        for name, values in long_tracks.smoothed(along, n, near, half).items():
            part = part.append_column(name, values)
        return part

    def place(part: pa.Table, n: np.ndarray, near: pa.Table, m: np.ndarray) -> pa.Table:
        first = np.cumsum(m) - m
        past, scale, rows, origin = (np.repeat(near[c].to_numpy()[first], n) for c in ("_offset", "_scale", "_rows", "_origin"))
        along = np.where(rows < 3, part["_along"].to_numpy(), origin + (past + part["_sum"].to_numpy()) * scale)
        offset_, length = near["offset"].to_numpy(), near["length"].to_numpy()
        at = [a + np.searchsorted(o[1:].round(9), v.round(9), side="left") for a, o, v in zip(first, np.split(offset_, first[1:]), np.split(along, np.cumsum(n)[:-1]), strict=True)]
        at = np.concatenate(at)
        values = {"link_id": near["link_id"].take(at), "s": pa.array((along - offset_[at]).clip(0.0, length[at])), "d": part["_lateral"]}
        return pa.table({c: values[c] if c in values else part[c] for c in columns})

    fields_on = f"{fields}, _along double, _lateral double"
    on = cut(whole_pairs(locked, of, keys, order, ["_at"], project, f"{fields_on}, levels array<double>, sizes array<long>"))
    fits = cut(long_tracks.fits(on.where("levels is not null").select(*keys, "levels", "sizes"), by))
    around = long_tracks.halos(long_tracks.fitted_edges(fits, by, half), by, half)
    near = long_tracks.joined(fits, around.select(*keys, "left", "right"), keys)
    stepped = cut(whole_pairs(on.select(lying), near, keys, order, [], smooth, f"{fields_on}, {long_tracks.SUMS}"))
    placed = long_tracks.joined(of.drop("px", "py"), long_tracks.scales(stepped, around, by), keys)
    kept = whole_pairs(stepped.drop("_total", "_gone"), placed, keys, order, ["_at"], place, fields)
    rest = ones.where("_alone").drop("_alone").unionByName(path.where("link_id is null").drop(*marks))
    return kept.unionByName(rest)


def snap(rows: DataFrame, links: DataFrame, by: list[str], *, reach: float = 20.0, k: int = 6, weight: float = 8.0, lane_width: float = 0.0, lanes_per_side: int = 4, wrong_cos: float = -0.3, trust_kmh: float = TRUST_KMH) -> DataFrame:
    """`rows` (by, row_id, x, y, heading, speed_kmh) moved to lane centres: link_id, lane_offset_m, snap_x, snap_y, snap_heading, wrong_way; nulls where no link is in reach.

    Links compete by distance plus a weighted penalty of direction; where lanes
    are not drawn one by one (`lane_width` over 0) the offset is rounded to the
    middle of a lane on the row's side.  A track whose directed rows mostly run
    against their links is on the wrong way as a whole.
    """
    track = Window.partitionBy(*by)
    found = project_onto(directions(rows, by, trust_kmh), links.select("link_id", "pts"), "row_id", reach).join(links.select("link_id", "directed"), "link_id")
    c = F.cos(F.radians("bearing") - F.col("_dir"))
    wrong = wrongness(F.col("bearing"), F.col("_dir"), F.col("directed"))
    near = found.withColumn("_r", F.row_number().over(Window.partitionBy("row_id").orderBy("distance", "link_id"))).where(F.col("_r") <= k)
    best = near.groupBy("row_id").agg(F.min_by(F.struct("link_id", "d", "foot_x", "foot_y", "bearing", "directed", c.alias("cos")), F.struct(F.round(F.col("distance") + weight * wrong, 9), "link_id")).alias("b"))
    rest = rows.join(best, "row_id", "left")
    d = F.col("b.d")
    side = F.when(d < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    lane = F.least(F.lit(float(lanes_per_side - 1)), F.greatest(F.lit(0.0), F.bround((F.abs(d) - lane_width / 2.0) / lane_width))) if lane_width else None
    offset = side * (lane * lane_width + lane_width / 2.0) if lane_width else F.lit(0.0)
    t = F.radians("b.bearing")
    ahead = F.count_if(F.col("b.directed")).over(track) * 2 > F.count("b.link_id").over(track)
    against = F.avg(F.when(F.col("b.directed"), F.col("b.cos"))).over(track) < wrong_cos
    backward = F.coalesce(ahead & against, F.lit(False))
    votes = F.sum(F.when(~F.col("b.directed"), F.signum("b.cos"))).over(track) < 0
    turned = F.when(F.col("b.directed"), backward).otherwise(F.coalesce(votes, F.lit(False)))
    heading = F.col("b.bearing") + F.when(turned, F.lit(180.0)).otherwise(F.lit(0.0))
    out = rest.withColumns({"link_id": F.col("b.link_id"), "lane_offset_m": F.when(d.isNotNull(), offset), "snap_x": F.col("b.foot_x") - offset * F.sin(t), "snap_y": F.col("b.foot_y") + offset * F.cos(t), "snap_heading": heading - 360.0 * F.floor((heading + 180.0) / 360.0), "wrong_way": backward})
    return out.drop("b")


def snap_quality(snapped: DataFrame, least_pct: float = 50.0, most_deg: float = 45.0) -> DataFrame:
    """One row: share of rows snapped, median change of heading, and whether both pass."""
    turn = F.col("snap_heading") - F.col("heading")
    rows = snapped.select(F.col("link_id").isNotNull().alias("on"), F.abs(turn - 360.0 * F.floor((turn + 180.0) / 360.0)).alias("dh"))
    out = rows.agg((100.0 * F.avg(F.col("on").cast("double"))).alias("snap_pct"), F.percentile("dh", F.lit(0.5)).alias("heading_median"))
    return out.withColumn("ok", (F.col("snap_pct") >= least_pct) & (F.coalesce("heading_median", F.lit(0.0)) <= most_deg))


def choose_source(quality: dict[str, tuple[bool, float]], order: list[str]) -> str | None:
    """Of map sources with (passes, share of rows matched): those that pass before others, then the larger share, then the order given."""
    known = [k for k in order if k in quality]
    return max(known, key=lambda k: (quality[k][0], quality[k][1], -order.index(k)), default=None)


def rebuild(states: DataFrame, links: DataFrame, prior_length: str = "length", prior_width: str = "width") -> DataFrame:
    """Matched rows (link_id, s, d, heading) with ground point, heading along the link (turned where it has no direction and the row faced the other way), and floor box."""
    from ..functions.geometry import floor_box
    from .spatial_join import segments

    seg = segments(links).withColumnRenamed("length", "_seg")
    rows = states.join(seg, "link_id", "left").where("link_id is null or (s >= s0 and s <= s0 + _seg + 1e-9)")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("row_id").orderBy("n"))).where("_r = 1")
    t = F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    part = F.col("s") - F.col("s0")
    x = F.col("ax") + part * F.cos(t) - F.col("d") * F.sin(t)
    y = F.col("ay") + part * F.sin(t) + F.col("d") * F.cos(t)
    rows = rows.join(links.select("link_id", F.col("directed").alias("_directed")), "link_id", "left")
    back = ~F.coalesce("_directed", F.lit(True)) & (F.cos(t - F.radians("heading")) < 0)
    heading = F.degrees(t) + F.when(F.coalesce(back, F.lit(False)), 180.0).otherwise(0.0)
    heading = heading - 360.0 * F.floor((heading + 180.0) / 360.0)
    out = rows.select(*(F.col(c) for c in states.columns if c not in ("heading",)), x.alias("x"), y.alias("y"), heading.alias("heading"))
    if prior_length in states.columns:
        out = out.withColumn("sat_floor_box", floor_box(F.col("x"), F.col("y"), F.col("heading"), F.col(prior_length), F.col(prior_width)))
    return out

"""Order-dependent algorithms on tracks longer than a task: stretches of frames are worked on apart and put together.

A stretch (`_chunk`) holds the rows whose order, divided by a length, has the
same floor.  Many stretches go to a call, their k-th rows being one step on
arrays, so that small ones cost no call each.  What joins the stretches of a track is small: a matrix or a few
numbers for each, combined track by track; rows are never gathered.

* Most likely path: a stretch is a max-plus matrix from the options of the row
  before it to those of its last row, with the frame in which each option's
  paths end, as a path that finds no way begins anew.  Scores are whole numbers
  of a millionth, so sums don't depend on how they are split, and ties neither.
* Non-decreasing fit: a stretch is a stack of pools.  A pool that is no lower
  than any pool before its stretch and no higher than any behind is final; only
  the others are pooled further, in one stack for each track.
* Smoothed progress: a stretch needs a few steps of its neighbours, and the
  sums of those before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .sequences import grid, lists, whole_groups, whole_pairs, with_column

#: No score; the sum of two is still a number.
NONE = -(1 << 61)
#: Scores are whole numbers of this part.
PART = 1e-6


def whole(score: np.ndarray) -> np.ndarray:
    """Scores as whole numbers; -inf is NONE."""
    return np.where(np.isfinite(score), np.rint(np.where(np.isfinite(score), score, 0.0) / PART), NONE).astype(np.int64)


def _kept(total: np.ndarray) -> np.ndarray:
    return np.where(total < NONE // 2, NONE, total)


def ranks(size: np.ndarray, begin: int = 0):
    """(t, the groups that have a t-th row), so that many groups take a step at once."""
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    for t in range(begin, int(size.max(initial=0))):
        yield t, order[: np.searchsorted(falling, -t)]


def forwards(start: np.ndarray, emit: np.ndarray, move: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, back) of many paths at once: best score of each option of each row and its option in the row before, -1 where none leads there.

    Rows lie path after path, `size` of them from `first` on.  start [paths, k]:
    scores of the first rows; emit [n, k]; move [n, k, k]: scores of the steps
    to a row (those of first rows are not used).  Where no option is reached the
    path begins anew.
    """
    scores, back = np.empty(emit.shape, np.int64), np.full(emit.shape, -1)
    scores[first] = start
    for t, g in ranks(size, 1):
        i = first[g] + t
        total = _kept(scores[i - 1][:, :, None] + move[i])
        best = total.max(axis=1)
        found = _kept(np.where(best > NONE, best + emit[i], NONE))
        reached = found > NONE
        back[i] = np.where(reached, total.argmax(axis=1), -1)
        scores[i] = np.where(reached.any(axis=1)[:, None], found, emit[i])
    return scores, back


def backwards(scores: np.ndarray, back: np.ndarray, last: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The options [n, m] of the best paths that end in the options `last` [paths, m]."""
    out, pick = np.empty((len(scores), last.shape[1]), int), last.copy()
    for t, g in ranks(size):
        i = first[g] + size[g] - 1 - t
        out[i] = np.where(pick[g] >= 0, pick[g], np.argmax(scores[i], axis=1)[:, None])
        pick[g] = np.take_along_axis(back[i], out[i], axis=1)
    return out


def passages(emit: np.ndarray, move: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, dies) of the rows behind the first ones of many paths, see `passage`: state is `through` where dies is -1, else `anew`."""
    k = emit.shape[1]
    state = np.where(np.eye(k, dtype=bool), 0, NONE)[None].repeat(len(size), axis=0)
    dies = np.full((len(size), k), -1)
    for t, g in ranks(size, 1):
        i = first[g] + t
        best = _kept(state[g][:, :, :, None] + move[i][:, None]).max(axis=2)
        found = _kept(np.where(best > NONE, best + emit[i][:, None], NONE))
        gone = found.max(axis=2) == NONE
        state[g] = np.where(gone[:, :, None], emit[i][:, None], found)
        dies[g] = np.where(gone & (dies[g] < 0), t, dies[g])
    return state, dies


def carries(entry: np.ndarray, state: np.ndarray, dies: np.ndarray) -> np.ndarray:
    """Scores of the last rows of many stretches from those of the rows before them."""
    live = entry > NONE
    stays = live & (dies < 0)
    best = np.where(stays[:, :, None], _kept(entry[:, :, None] + state), NONE).max(axis=1)
    anew = state[np.arange(len(state)), np.argmax(np.where(live, dies, -1), axis=1)]
    return np.where(stays.any(axis=1)[:, None], best, anew)


def _one(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(1, int), np.array([n])


def _onto(move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Steps between rows as steps to rows."""
    return np.concatenate([np.zeros((1, emit.shape[1], emit.shape[1]), np.int64), move])


def forward(start: np.ndarray, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`forwards` of one path; move [n - 1, k, k]."""
    return forwards(start[None], emit, _onto(move, emit), *_one(len(emit)))


def backward(scores: np.ndarray, back: np.ndarray, last: int) -> np.ndarray:
    """The options of the best path that ends in option `last`."""
    return backwards(scores, back, np.array([[last]]), *_one(len(scores)))[:, 0]


def passage(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(through, dies, anew) of the rows behind the first one.

    through[i, j]: best score from option i of the first row to option j of the
    last, NONE if there is no way.  dies[i]: the row in which no option can be
    reached from i any more, -1 if there is none.  anew[i]: scores of the last
    row if the path begins anew in that row.
    """
    state, dies = (x[0] for x in passages(emit, _onto(move, emit), *_one(len(emit))))
    return np.where(dies[:, None] < 0, state, NONE), dies, np.where(dies[:, None] < 0, NONE, state)


def carried(entry: np.ndarray, through: np.ndarray, dies: np.ndarray, anew: np.ndarray) -> np.ndarray:
    """Scores of a stretch's last row from those of the row before it."""
    return carries(entry[None], np.where(dies[:, None] < 0, through, anew)[None], dies[None])[0]


def chunked(order: str, length: float) -> Column:
    return F.floor(F.col(order) / F.lit(length)).cast("long")


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys, nulls being equal; the keys are those of `left`."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return left.join(r, condition, how).drop(*(f"_r_{k}" for k in keys))


def ordered(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def kinds_of(rows: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)


def entries(summaries: DataFrame, by: list[str], k: int) -> DataFrame:
    """Rows (by, _chunk, entry, last): the scores before each stretch, and the best option of a track's last row on its last stretch.

    `summaries` has for each stretch state (flat) and dies, see `passages`, or,
    for a track's first, `start`, the scores of its last row; null for a stretch
    without options.  Rows have k options.
    """
    keys = [*by, "_chunk"]

    def run(table: pa.Table, first: np.ndarray) -> pa.Table:
        size = np.diff([*first, len(table)])
        (start, begins), (state, _), (dies, goes) = (grid(table[c], w, NONE, np.int64) for c, w in (("start", k), ("state", k * k), ("dies", k)))
        state = state.reshape(-1, k, k)
        entry, known = np.full((len(table), k), NONE), np.zeros(len(table), bool)
        score, any_ = np.full((len(size), k), NONE), np.zeros(len(size), bool)
        for t, g in ranks(size):
            i = first[g] + t
            entry[i], known[i] = score[g], any_[g]
            a, b = begins[i] > 0, goes[i] > 0
            score[g[b]] = carries(score[g[b]], state[i[b]], dies[i[b]])
            score[g[a]], any_[g[a]] = start[i[a]], True
        last = np.full(len(table), -1)
        last[first + size - 1] = np.where(any_, np.argmax(score, axis=1), -1)
        return table.select(keys).append_column("entry", lists(entry[known].ravel(), known * k, known)).append_column("last", pa.array(last, mask=last < 0))

    return whole_groups(summaries, by, ["_chunk"], run, f"{kinds_of(summaries, keys)}, entry array<long>, last long")


def exits(maps: DataFrame, by: list[str], k: int) -> DataFrame:
    """Rows (by, _chunk, exit): the option of each stretch's last row on the best path.

    `maps` has for each stretch `to`, the option of the row before it for each
    of the k options of its last row (null for a track's first), and `last`.
    """
    keys = [*by, "_chunk"]

    def run(table: pa.Table, first: np.ndarray) -> pa.Table:
        size = np.diff([*first, len(table)])
        to, goes = grid(table["to"], k, -1, np.int64)
        at, out = table["last"].fill_null(-1).to_numpy()[first + size - 1].copy(), np.empty(len(table), np.int64)
        for t, g in ranks(size):
            i = first[g] + size[g] - 1 - t
            out[i] = at[g]
            go = (goes[i] > 0) & (at[g] >= 0)
            at[g[go]] = to[i[go], at[g[go]]]
        return table.select(keys).append_column("exit", pa.array(out, mask=out < 0))

    return whole_groups(maps, by, ["_chunk"], run, f"{kinds_of(maps, keys)}, exit long")


def pools(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels and sizes of the pools of the nearest non-decreasing sequence."""
    return pooled(np.asarray(y, float), np.ones(len(y), np.int64))


def pooled(levels: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools of pools: neighbours that fall become their mean."""
    level: list[float] = []
    size: list[int] = []
    for v, m in zip(levels.tolist(), sizes.tolist(), strict=True):
        level.append(v)
        size.append(m)
        while len(level) > 1 and level[-2] > level[-1]:
            a, n = level.pop(), size.pop()
            level[-1] = (level[-1] * size[-1] + a * n) / (size[-1] + n)
            size[-1] += n
    return np.array(level), np.array(size, np.int64)


def at_firsts(values: pa.Array, first: np.ndarray, n: int) -> pa.Array:
    """A value for each stretch as a column of `n` rows: on the first row of the stretch, null on the others."""
    at = np.full(n, -1)
    at[first] = np.arange(len(first))
    return values.take(pa.array(at, mask=at < 0))


def stacks(values: np.ndarray, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Levels and sizes of the pools of each stretch."""
    found = [pools(v) for v in np.split(values, first[1:])]
    size = np.array([len(f[0]) for f in found])
    return lists(np.concatenate([f[0] for f in found]), size), lists(np.concatenate([f[1] for f in found]), size)


def fits(found: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, _chunk, levels, sizes, _open, fits) of stacks (by, _chunk, levels, sizes): which pools are not final, and the levels of the pools that those are in."""
    keys = [*by, "_chunk"]
    track = Window.partitionBy(*by).orderBy(*ordered("_chunk"))
    before = F.coalesce(F.max(F.element_at("levels", -1)).over(track.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf")))
    behind = F.coalesce(F.min(F.element_at("levels", 1)).over(track.rowsBetween(1, Window.unboundedFollowing)), F.lit(float("inf")))
    found = found.withColumns({"_before": before, "_behind": behind}).withColumn("_open", F.transform("levels", lambda v: (v < F.col("_before")) | (v > F.col("_behind")))).drop("_before", "_behind")
    some = {c: F.filter(c, lambda _, i: F.get("_open", i)).alias(c) for c in ("levels", "sizes")}

    def pool(part: pa.Table, first: np.ndarray) -> pa.Table:
        of = part["levels"].combine_chunks()
        ends = of.offsets.to_numpy()
        level, size = of.flatten().to_numpy(), part["sizes"].combine_chunks().flatten().to_numpy()
        cuts = (ends - ends[0])[first[1:]]
        found = []
        for v, n in zip(np.split(level, cuts), np.split(size, cuts), strict=True):
            fit, wide = pooled(v, n)
            # the pool that each of the stretches' pools is in
            found.append(fit[np.searchsorted(np.cumsum(wide), np.cumsum(n))])
        return part.select(keys).append_column("fits", lists(np.concatenate(found), np.diff(ends)))

    fitted = cut(whole_groups(found.select(*keys, *some.values()).where("size(levels) > 0"), by, ["_chunk"], pool, f"{kinds_of(found, keys)}, fits array<double>"))
    return joined(found, fitted, keys, "left")


def fitted(of: pa.Table) -> np.ndarray:
    """The values of the rows of stretches from their `fits`."""
    level, size, open_, fit = (of[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("levels", "sizes", "_open", "fits"))
    level = level.copy()
    level[open_.astype(bool)] = fit
    return np.repeat(level, size)


def monotone(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """`rows` (with _chunk) with `value` made non-decreasing along each track, however long."""
    keys, columns = [*by, "_chunk"], rows.columns

    def stack(part: pa.Table, first: np.ndarray) -> pa.Table:
        levels, sizes = stacks(part[value].to_numpy(), first)
        return part.select(keys).take(first).append_column("levels", levels).append_column("sizes", sizes)

    def fill(part: pa.Table, n: np.ndarray, of: pa.Table, m: np.ndarray) -> pa.Table:
        return with_column(part, value, fitted(of)).select(columns)

    found = cut(whole_groups(rows.select(*keys, order, value), keys, [order], stack, f"{kinds_of(rows, keys)}, levels array<double>, sizes array<long>"))
    return whole_pairs(rows, fits(found, by), keys, [order], [], fill, rows.schema)


#: What smoothed progress needs of a stretch's neighbours.
EDGES = "n long, head array<double>, tail array<double>"


def edges(values: np.ndarray, first: np.ndarray, half: int) -> dict[str, pa.Array]:
    """EDGES of each stretch: how many rows it has, its first values and its last."""
    size = np.diff([*first, len(values)])
    wide = np.minimum(size, half + 1)
    inside = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    head, tail = (values[np.repeat(a, wide) + inside] for a in (first, first + size - wide))
    return {"n": pa.array(size, pa.int64()), "head": lists(head, wide), "tail": lists(tail, wide)}


def fitted_edges(fits: DataFrame, by: list[str], half: int) -> DataFrame:
    """Rows (by, _chunk) with the EDGES of stretches after the fit: no look at their rows is needed."""
    keys = [*by, "_chunk"]

    def edge(batches):
        for batch in batches:
            if not len(batch):
                continue
            part = pa.Table.from_batches([batch])
            of = part["sizes"].combine_chunks()
            ends = of.offsets.to_numpy()
            size = np.add.reduceat(of.flatten().to_numpy(), ends[:-1] - ends[0])
            out = part.select(keys)
            for name, values in edges(fitted(part), np.cumsum(size) - size, half).items():
                out = out.append_column(name, values)
            yield from out.to_batches()

    return fits.mapInArrow(edge, f"{kinds_of(fits, keys)}, {EDGES}")


def halos(ends: DataFrame, by: list[str], half: int) -> DataFrame:
    """Rows (by, _chunk, left, right, rows, origin) of the EDGES of stretches: the values before and behind each, the track's number of rows and its first value."""
    keys = [*by, "_chunk"]

    def halo(part: pa.Table, first: np.ndarray) -> pa.Table:
        heads, tails, n = part["head"].to_pylist(), part["tail"].to_pylist(), part["n"].to_numpy()
        left: list = []
        right: list = [None] * len(part)
        ends = [*first[1:].tolist(), len(part)]
        for a, b in zip(first.tolist(), ends, strict=True):
            near: list[float] = []
            for tail in tails[a:b]:
                left.append(near)
                near = [*near, *tail][-half - 1 :]
            near = []
            for i in range(b - 1, a - 1, -1):
                right[i] = near
                near = [*heads[i], *near][: half + 1]
        size = np.diff([*first, len(part)])
        out = part.select(keys)
        for name, values, kind in (("left", left, pa.list_(pa.float64())), ("right", right, pa.list_(pa.float64())), ("rows", np.repeat(np.add.reduceat(n, first), size), pa.int64()), ("origin", np.repeat([heads[a][0] for a in first], size), pa.float64())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    return cut(whole_groups(ends, by, ["_chunk"], halo, f"{kinds_of(ends, keys)}, left array<double>, right array<double>, rows long, origin double"))


#: A row's smoothed way from the start of its stretch; on a stretch's first row the whole, and what was gone before smoothing.
SUMS = "_sum double, _total double, _gone double"


def smoothed(values: np.ndarray, n: np.ndarray, of: pa.Table, half: int) -> dict[str, pa.Array]:
    """SUMS of the rows of stretches, `n` each, from their `halos`."""
    (left, before), (right, behind) = ((c.flatten().to_numpy(), np.diff(c.offsets.to_numpy())) for c in (of[name].combine_chunks() for name in ("left", "right")))
    # stretch after stretch: what is before, its own rows, what is behind
    wide = before + n + behind
    begin = np.cumsum(wide) - wide
    inside = lambda size: np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    around = np.empty(wide.sum())
    own = np.repeat(begin + before, n) + inside(n)
    for at, some in ((np.repeat(begin, before) + inside(before), left), (own, values), (np.repeat(begin + before + n, behind) + inside(behind), right)):
        around[at] = some
    step = np.clip(np.diff(around, append=0.0), 0.0, None)
    # the step to each row; a track's first row has none, nor has its only one
    real = own > np.repeat(begin, n)
    least, most = np.repeat(begin, n), np.repeat(np.maximum(begin, begin + wide - 2), n)
    near = ((own - 1)[:, None] + np.arange(-half, half + 1)).clip(least[:, None], most[:, None])
    out, mine = np.where(real, step[near].mean(axis=1), 0.0), np.where(real, step[own - 1], 0.0)
    first = np.cumsum(n) - n
    sums = np.concatenate([np.cumsum(v) for v in np.split(out, first[1:])])
    once = {"_total": sums[first + n - 1], "_gone": np.add.reduceat(mine, first)}
    return {"_sum": pa.array(sums)} | {c: at_firsts(pa.array(v), first, len(values)) for c, v in once.items()}


def scales(stepped: DataFrame, around: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, _chunk, _offset, _scale, _rows, _origin) of SUMS and `halos`: what makes of a row's sum its place."""
    keys = [*by, "_chunk"]
    sums = stepped.where("_total is not null").select(*keys, "_total", "_gone")
    track, earlier = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(*ordered("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    total, gone = F.sum("_total").over(track), F.sum("_gone").over(track)
    scaled = sums.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_offset"), F.when((total > 1e-9) & (gone > 1e-9), gone / total).otherwise(1.0).alias("_scale"))
    return joined(scaled, around.select(*keys, F.col("rows").alias("_rows"), F.col("origin").alias("_origin")), keys)


def progress(rows: DataFrame, by: list[str], order: str, value: str, width: int) -> DataFrame:
    """`rows` (with _chunk) with positions of a smoothed speed along each track, however long; `width` is odd and 3 or more."""
    keys, columns, half = [*by, "_chunk"], rows.columns, width // 2

    def edge(part: pa.Table, first: np.ndarray) -> pa.Table:
        out = part.select(keys).take(first)
        for name, values in edges(part[value].to_numpy(), first, half).items():
            out = out.append_column(name, values)
        return out

    def smooth(part: pa.Table, n: np.ndarray, of: pa.Table, m: np.ndarray) -> pa.Table:
        out = part.select(columns)
        for name, values in smoothed(part[value].to_numpy(), n, of, half).items():
            out = out.append_column(name, values)
        return out

    around = halos(whole_groups(rows.select(*keys, order, value), keys, [order], edge, f"{kinds_of(rows, keys)}, {EDGES}"), by, half)
    stepped = cut(whole_pairs(rows, around.select(*keys, "left", "right"), keys, [order], [], smooth, f"{kinds_of(rows, columns)}, {SUMS}"))
    out = joined(stepped, scales(stepped, around, by), keys)
    moved = F.col("_origin") + (F.col("_offset") + F.col("_sum")) * F.col("_scale")
    return out.withColumn(value, F.when(F.col("_rows") < 3, F.col(value)).otherwise(moved)).select(*columns)

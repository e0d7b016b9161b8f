"""Assignment of most weight over a table of edges, of which no task needs more than a part.

1. An edge that is the heaviest at both its ends, and weighs no less than the
   second heaviest at one end and at the other together, is in an assignment of
   most weight: any that lacks it gains by taking it for the one or two edges
   that it has there instead.  Such edges are taken, with all edges at their
   ends gone, for as long as that takes many.
2. What is left falls into components.  Those whose matrix has up to CELLS cells
   are solved by shortest augmenting paths, each in a task.
3. Larger ones are solved together by an auction in rounds of joins: each free
   bidder offers for the object that is worth most to it, beyond that object's
   price, as much more as it prefers it to the next best; each object goes to
   the best offer, whose price it has then.  Offers rise by at least a step,
   which begins coarse and is refined; with the last one the result is exact.

   An auction assigns all bidders.  So every node stands on both sides, once as
   itself and once as a partner of those left single: an assignment of this
   doubled graph that leaves none over is one of the first graph, and the other
   way round, of the same weight.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .assignment import assign
from .graph import components, cut

#: Cells of a component's matrix that a task holds.
CELLS = 4_000_000
#: Edges are taken ahead as long as a round takes this share of what is left.
WORTH = 0.05
#: Each step of the auction is this part of the one before.
FINER = 5


def most_weight(edges: DataFrame, cells: int = CELLS) -> DataFrame:
    """Rows (a, b, w) of an assignment of most total weight over edges (a, b, w); each a and each b is in one row at most.

    Weights are whole numbers; edges of weight 0 or less, or with a null, are
    never taken; of repeated edges the heaviest counts.  Of assignments of equal
    weight any may come out.  An empty table gives no rows.
    """
    left = cut(edges.where("w > 0 and a is not null and b is not null").groupBy("a", "b").agg(F.max("w").cast("long").alias("w")))
    total, taken = left.count(), []
    while total:
        best = cut(_dominant(left))
        rest = cut(left.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti"))
        taken.append(best)
        before, total = total, rest.count()
        left = rest
        if before - total < WORTH * before:
            break
    if total:
        taken += _solved(left, cells)
    out = left.limit(0)
    for part in taken:
        out = out.unionByName(part)
    return out


def _dominant(edges: DataFrame) -> DataFrame:
    """The edges that are heaviest at both ends and weigh no less than the second heaviest at both together."""
    parts = edges
    for end, other in (("a", "b"), ("b", "a")):
        top = F.sort_array(F.collect_list(F.struct("w", other)), asc=False)
        # at most two of each partition's edges of an end are needed
        near = edges.withColumn("_r", F.row_number().over(Window.partitionBy(end).orderBy(F.desc("w"), F.desc(other)))).where("_r <= 2")
        first = near.groupBy(end).agg(top.alias("_top")).select(end, F.col("_top")[0][other].alias(f"_{other}"), F.coalesce(F.get("_top", F.lit(1))["w"], F.lit(0)).alias(f"_second_{end}"))
        parts = parts.join(first, end).where(F.col(other) == F.col(f"_{other}")).drop(f"_{other}")
    return parts.where("w >= _second_a + _second_b").select("a", "b", "w")


def _solved(edges: DataFrame, cells: int) -> list[DataFrame]:
    """Assignments of the components of `edges`, the small and the large ones."""
    # ids of both sides are numbers of this graph
    names = [edges.select(end).distinct().withColumn(f"_{end}", F.monotonically_increasing_id() * 2 + k) for k, end in enumerate("ab")]
    named = cut(edges.join(cut(names[0]), "a").join(cut(names[1]), "b"))
    label = components(named.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("id").alias("_a"), "component")
    labelled = named.join(label, "_a")
    sizes = labelled.groupBy("component").agg((F.count_distinct("_a") * F.count_distinct("_b")).alias("_cells"))
    labelled = cut(labelled.join(sizes, "component"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.select("a", "b", "w").schema.fields)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        (i, rows), (j, columns) = pd.factorize(part["a"]), pd.factorize(part["b"])
        m = np.zeros((len(rows), len(columns)))
        m[i, j] = part.w
        keep = np.zeros_like(m, bool)
        for x, y in assign(-m):
            keep[x, y] = True
        return part[keep[i, j]][["a", "b", "w"]]

    out = [labelled.where(F.col("_cells") <= cells).groupBy("component").applyInPandas(solve, kinds)]
    large = labelled.where(F.col("_cells") > cells)
    if large.limit(1).count():
        won = auction(large.select("_a", "_b", "w"))
        out.append(large.join(won, ["_a", "_b"], "left_semi").select("a", "b", "w"))
    return out


def _doubled(edges: DataFrame) -> DataFrame:
    """Rows (bidder, object, w): nodes as themselves (2n) and as partners of single ones (2n + 1)."""
    one, other, none = F.col("_a") * 2, F.col("_b") * 2, F.lit(0).cast("long")
    sides = [(one, other, F.col("w")), (one, one + 1, none), (other + 1, other, none), (other + 1, one + 1, none)]
    both = F.array(*(F.struct(x.alias("bidder"), y.alias("object"), w.alias("w")) for x, y, w in sides))
    return edges.select(F.inline(both)).distinct()


def auction(edges: DataFrame) -> DataFrame:
    """Rows (_a, _b) of an assignment of most weight over edges (_a, _b, w) of numbers, distinct over both sides.

    Each round is a few joins and combining aggregates; what a bidder weighs up
    are the edges it has.
    """
    graph = _doubled(edges)
    bidders = graph.select("bidder").distinct().count()
    # whole steps of 1 are exact once weights are multiples of more than there are bidders
    graph = cut(graph.withColumn("w", F.col("w") * (bidders + 1)))
    state = cut(graph.select("object").distinct().select("object", F.lit(0).cast("long").alias("price"), F.lit(None).cast("long").alias("owner")))
    step = max(1, graph.agg(F.max("w")).first()[0] // FINER)
    everyone = cut(graph.select("bidder").distinct())
    while True:
        state = state.withColumn("owner", F.lit(None).cast("long"))
        while True:
            free = everyone.join(state.where("owner is not null").select(F.col("owner").alias("bidder")), "bidder", "left_anti")
            worth = graph.join(free, "bidder").join(state.select("object", "price"), "object").withColumn("value", F.col("w") - F.col("price"))
            choice = worth.groupBy("bidder").agg(F.sort_array(F.collect_list(F.struct("value", "object", "price")), asc=False).alias("c"))
            offer = choice.select(F.col("c")[0]["object"].alias("object"), (F.col("c")[0]["price"] + F.col("c")[0]["value"] - F.col("c")[1]["value"] + step).alias("offer"), "bidder")
            best = offer.groupBy("object").agg(F.max(F.struct("offer", "bidder")).alias("best"))
            after = cut(state.join(best, "object", "left").select("object", F.coalesce("best.offer", "price").alias("price"), F.coalesce("best.bidder", "owner").alias("owner")))
            state = after
            if after.where("owner is not null").count() == bidders:
                break
        if step == 1:
            won = state.where("owner % 2 = 0 and object % 2 = 0")
            return won.select((F.col("owner") / 2).cast("long").alias("_a"), (F.col("object") / 2).cast("long").alias("_b"))
        step = max(1, step // FINER)

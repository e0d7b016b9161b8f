"""Near duplicates by circulant MinHash.

A text's set is its distinct five-word shingles.  Two permutations of the
32-bit numbers make all signature coordinates: the first scatters the shingles,
the second, circularly shifted by k, gives coordinate k (C-MinHash).  Bands of
the signature propose candidates, exact Jaccard similarity on the full sets
confirms them, and links are closed to components.

How hot groups are kept cheap and whole:

* Texts with equal sets are one class before anything else (a combining
  aggregate), so copies are never compared.
* In each bucket of a band all members are compared with one hub only, the
  member that shares most buckets.  That is linear in the bucket's size.
* Members that did not reach the hub's component may still be linked to another
  member.  In REHUBS further rounds one of them is the hub of its bucket, for
  all members of other components.
* Those still outside, and only they, are compared with the rest of the bucket,
  in blocks of bounded bytes by one vectorised pass; pairs are never rows.

With 32 bands of 4 rows a pair at similarity 0.75 is proposed with probability
1 - 5e-6, and a pair above it with more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, with_ids
from .components import components
from .hashing import mix, shingles

#: Shingles, together, of the texts of one side of a block.
BLOCK_SHINGLES = 1 << 16
#: Rounds with another hub before blocks are compared.
REHUBS = 2
_CHUNK = 1 << 14


def _scatter(x: np.ndarray) -> np.ndarray:
    """Elements of the universe: the first permutation, on 32 bits."""
    return (mix(x) >> np.uint64(32)).astype(np.uint32)


def signatures(ids: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """uint32 [texts, size]: the circulant MinHash signature of each text; texts without shingles have all ones."""
    texts = len(first) - 1
    out = np.full((size, texts), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(first[full + 1], first[full[at]] + _CHUNK, side="right")))
        some = full[at:to]
        base = _scatter(ids[first[some[0]] : first[some[-1] + 1]])
        begin = first[some] - first[some[0]]
        x, y = np.empty_like(base), np.empty_like(base)
        for k in range(size):
            np.add(base, np.uint32(k), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x7FEB352D), out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x846CA68B), out=x)
            out[k, some] = np.minimum.reduceat(x, begin)
        at = to
    return out.T


def _distinct(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = [np.unique(ids[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return (np.concatenate(kept) if kept else ids[:0]), np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int64)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
        return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _sign(text: str, size: int, bands: int, rows: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, first = _distinct(*shingles(batch.column(text).to_pylist(), size))
        sig = signatures(ids, first, bands * rows).astype(np.uint64).reshape(len(first) - 1, bands, rows)
        with np.errstate(over="ignore"):
            keys = np.zeros(sig.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for r in range(rows):
                keys = mix(keys ^ sig[:, :, r])
            keys = keys.view(np.int64)
        band = pa.ListArray.from_arrays(np.arange(0, (len(first) - 1) * bands + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1)))
        at = batch.schema.get_field_index(text)
        kept = [(c, n) for k, (c, n) in enumerate(zip(batch.columns, batch.schema.names, strict=True)) if k != at]
        return pa.RecordBatch.from_arrays([*(c for c, _ in kept), *_identity(ids, first), band], names=[*(n for _, n in kept), *IDENTITY, "bands"])

    return run


#: What equal sets have in common: their size and two sums.
IDENTITY = ("n", "k1", "k2")


def _identity(ids: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.diff(first)), pa.array(_sums(ids, first)), pa.array(_sums(mix(ids ^ np.uint64(0xA5A5A5A5)), first))]


def _pack(text: str, size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, first = _distinct(*shingles(batch.column(text).to_pylist(), size))
        sets = [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.RecordBatch.from_arrays([*_identity(ids, first), pa.array(sets, pa.binary())], names=[*IDENTITY, "items"])

    return run


def _enough(shared: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def _confirm(percent: int):
    """Rows (a, b, sa, sb) whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep[i] = _enough(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def block_links(left_ids, left_labels, left_sets, right_ids, right_labels, right_sets, percent: int) -> list[tuple[int, int]]:
    """Enough of the confirmed links (a, b) between different labels to join all labels that any link joins.

    One pass over the right side for each left text: its shingles are marked
    and the marks below each right text counted.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    size = np.array([len(s) for s in right_sets], np.int64)
    if not len(size) or not left_sets:
        return []
    known, place = np.unique(np.concatenate(right_sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    mark = np.zeros(len(known), np.uint8)
    found = []
    for a, label, items in zip(left_ids, left_labels, left_sets, strict=True):
        at = np.minimum(np.searchsorted(known, items), len(known) - 1)
        hit = at[known[at] == items]
        if not len(hit):
            continue
        mark[hit] = 1
        shared = np.add.reduceat(mark[place], begin, dtype=np.int64)
        mark[hit] = 0
        for j in np.flatnonzero(_enough(shared, len(items), size, percent)):
            x, y = root(int(label)), root(int(right_labels[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((int(a), int(right_ids[j])))
    return found


def _blocks(percent: int):
    """Of a group of rows (side, id, label, items): links between the two sides."""

    def run(group: pa.Table) -> pa.Table:
        sides = []
        for side in (0, 1):
            t = group.filter(pa.compute.equal(group.column("side"), side))
            sides.append((t.column("id").to_pylist(), t.column("label").to_pylist(), [np.frombuffer(x.as_py(), np.uint64) for x in t.column("items")]))
        links = block_links(*sides[0], *sides[1], percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, shingle: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, *keep, n_shingles, component_id, kept, group_id), one for each row of `docs`.

    Texts whose sets have a similarity of at least `percent` hundredths are
    linked; texts that links join are a group, group_id its number in this
    result.  component_id is the smallest id of the group, null if none of its
    rows has one; kept says that it is the row's own id.  Null or blank texts
    have n_shingles 0, no group, are linked with nothing and have their own id
    as component.  Each row counts with its own text: rows of one id with
    different texts may be in different groups, rows without an id take part.
    Ids of any ordered type will do.  Texts of any length are compared whole.  Other columns are ignored.  An
    empty table gives no rows.
    """
    named = {f"_keep{k}": F.col(c) for k, c in enumerate(keep)}
    source = docs.select(F.col(id_col).alias("id"), *(c.alias(n) for n, c in named.items()), F.col(text).alias("text"))
    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(named, keep, strict=True))
    signed = materialize(map_arrow(source, _sign("text", shingle, bands, rows), f"id {docs.schema[id_col].dataType.simpleString()}, {kinds}n long, k1 long, k2 long, bands array<long>", "text"), "signed")
    classes = signed.where("n > 0").groupBy(*IDENTITY).agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    linked = components(_links(source.select("id", "text"), classes, shingle, percent)).select(F.col("id").alias("class"), F.col("component").alias("found"))
    group = materialize(classes.drop("bands").join(linked, "class", "left").withColumn("group", F.coalesce("found", "class")), "groups")
    least = group.groupBy("group").agg(F.min("id").alias("component"))
    of_class = group.select(*IDENTITY, "group").join(least, "group")
    out = signed.drop("bands").join(of_class, list(IDENTITY), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), *(F.col(n).alias(c) for n, c in zip(named, keep, strict=True)),
        F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"), F.col("group").alias("group_id"),
    )


def _links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Rows (a, b): links between classes that span their groups."""
    banded = classes.select(F.col("class").alias("id"), "n", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(banded.join(crowded, "key"), "shared")
    score = shared.groupBy("id").agg(F.sum("size").alias("score"))
    shared = materialize(shared.join(score, "id").select("id", "n", "key", "score"), "scored")
    near = materialize(classes.join(shared.select(F.col("id").alias("class")).distinct(), "class", "left_semi").select(*IDENTITY, "class", "id"), "near")
    holders = with_ids(docs, near.where("id is not null").select("id").distinct(), "id").unionByName(docs.where("id is null"))
    packed = map_arrow(holders.select("text"), _pack("text", shingle), "n long, k1 long, k2 long, items binary", "text")
    sets = materialize(packed.join(near.select(*IDENTITY, F.col("class").alias("id")), list(IDENTITY)).select("id", "items").dropDuplicates(["id"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        tested = pairs.distinct().join(sets.select(F.col("id").alias("a"), F.col("items").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("sb")), "b")
        return materialize(tested.mapInArrow(_confirm(percent), "a long, b long"), "close")

    # sets whose sizes are too unlike can't be similar enough
    sizes = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    best = F.max(F.struct("score", (-F.col("id")).alias("at"), "n"))
    hub = shared.groupBy("key").agg(best.alias("hub")).select("key", (-F.col("hub.at")).alias("hub"), F.col("hub.n").alias("hub_n"))
    links = confirmed(shared.join(hub, "key").where("id <> hub").where(sizes).select(F.col("id").alias("a"), F.col("hub").alias("b")))
    labels = components(links)
    for _ in range(REHUBS):
        labelled = materialize(_mixed(shared.join(labels, "id", "left").select("id", "n", "key", "score", F.coalesce("component", "id").alias("label"))), "labelled")
        if not labelled.limit(1).count():
            return links
        hub = labelled.where("label <> main").groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("at"), "label", "n")).alias("hub")).select("key", (-F.col("hub.at")).alias("hub"), F.col("hub.label").alias("hub_label"), F.col("hub.n").alias("hub_n"))
        found = confirmed(labelled.join(hub, "key").where("label <> hub_label").where(sizes).select(F.col("id").alias("a"), F.col("hub").alias("b")))
        if found.limit(1).count():
            links = links.unionByName(found)
            labels = components(links)
    labelled = _mixed(shared.join(labels, "id", "left").select("id", "key", F.coalesce("component", "id").alias("label")))
    return links.unionByName(_rest(labelled, sets, percent))


def _mixed(labelled: DataFrame) -> DataFrame:
    """Rows (..., key, label) of buckets with several labels, with main, the label that most of the bucket has."""
    counted = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("key").agg(F.max(F.struct("n", (-F.col("label")).alias("at"))).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("key", (-F.col("top.at")).alias("main"))
    return labelled.join(main, "key")


def _rest(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of members of a bucket that are not in the component of most of it."""
    # side 0: members outside the main component; side 1: all members
    member = materialize(labelled.select("main", "id", "label").distinct(), "mixed")
    sized = member.join(sets.select("id", (F.length("items") / 8).cast("long").alias("n")), "id")
    parts = sized.groupBy("main").agg(
        F.ceil(F.sum(F.when(F.col("label") != F.col("main"), F.col("n")).otherwise(0)) / BLOCK_SHINGLES).cast("int").alias("left_parts"),
        F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("right_parts"),
    )
    placed = member.join(parts, "main").withColumn("h", F.xxhash64("id"))
    i, j = F.pmod("h", F.greatest("left_parts", F.lit(1))).cast("int"), F.pmod("h", F.greatest("right_parts", F.lit(1))).cast("int")
    one = placed.where("label <> main").select("main", i.alias("i"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("right_parts") - 1, F.lit(0)))).alias("j"), F.lit(0).alias("side"), "id", "label")
    two = placed.select("main", F.explode(F.sequence(F.lit(0), F.greatest(F.col("left_parts") - 1, F.lit(0)))).alias("i"), j.alias("j"), F.lit(1).alias("side"), "id", "label")
    filled = one.unionByName(two).join(sets, "id")
    return materialize(filled.groupBy("main", "i", "j").applyInArrow(_blocks(percent), "a long, b long"), "rest")

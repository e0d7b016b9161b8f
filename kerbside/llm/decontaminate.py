"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared after A-Z are lower-cased and each run of white space has
become one space.  A test item of m characters may differ by
k = floor(m * error_rate) edits.  It is cut into k + 1 pieces; k edits leave at
least one piece untouched, so every occurrence within the budget shows an exact
piece.  One automaton finds all pieces of all items in one pass over a text, and
Myers' bit-parallel distance checks the window around each find.  Items shorter
than MIN_CHARS have no budget and count where they stand as whole words.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import map_arrow, materialize

#: Characters of items in one automaton.  More items are handled in several passes over the documents.
BLOCK_CHARS = 4_000_000
#: Normalised characters from which an item may differ by edits.
MIN_CHARS = 20
#: Documents with finds that a broadcast may hold; more are joined by a shuffle.
BROADCAST_FINDS = 500_000


def normal(text: str | None) -> str:
    """The text as it is compared."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()).decode("utf-8", "surrogatepass")


def budget(length: int, error_rate: float) -> int:
    """Edits that an item of `length` characters may differ by."""
    return int(length * error_rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(place, piece): the item cut into edits + 1 pieces whose lengths differ by one at most."""
    parts = edits + 1
    cuts = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Pattern:
    """An item for Myers' algorithm: the least edit distance of it to any substring of a text."""

    def __init__(self, item: str) -> None:
        self.item, self.length = item, len(item)
        self.masks: dict[str, int] = {}
        for k, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << k
        self.all, self.top = (1 << self.length) - 1, 1 << (self.length - 1)

    def distance(self, text: str) -> int:
        """Least distance over all substrings of `text`, the empty one included."""
        if self.item in text:
            return 0
        up, down, score, full, top = self.all, 0, self.length, self.all, self.top
        best, masks = score, self.masks.get
        for c in text:
            eq = masks(c, 0)
            x = eq | down
            d = (((eq & up) + up) ^ up) | x
            h_up = down | ~(d | up) & full
            h_down = up & d
            if h_up & top:
                score += 1
            elif h_down & top:
                score -= 1
                if score < best:
                    best = score
            h_up = h_up << 1 & full
            h_down = h_down << 1 & full
            up = h_down | ~(x | h_up) & full
            down = h_up & x
        return best


class Matcher:
    """Finds items (id, text) in documents, each within its edit budget."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, min_chars: int = MIN_CHARS) -> None:
        self.items = [(i, Pattern(t), budget(len(t), error_rate) if len(t) >= min_chars else 0) for i, t in items]
        self.whole = [len(t) < min_chars for _, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, p, edits) in enumerate(self.items):
            for place, piece in pieces(p.item, edits):
                found.setdefault(piece, []).append((k, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def _windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of stretches that may hold an item; overlapping ones are one."""
        near: dict[int, tuple[int, int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for k, place in where:
                _, p, edits = self.items[k]
                start = end + 1 - length - place
                if self.whole[k] and (text[max(0, start - 1) : start].isalnum() or text[end + 1 : end + 2].isalnum()):
                    continue
                a, b = start - edits, start + p.length + edits
                old = near.get(k)
                if old is None:
                    near[k] = (a, b)
                elif a <= old[1] and b - old[0] <= 8 * p.length:
                    near[k] = (min(a, old[0]), max(b, old[1]))
                else:
                    yield k, *old
                    near[k] = (a, b)
        for k, (a, b) in near.items():
            yield k, a, b

    def find(self, text: str) -> list[tuple[int | None, int]]:
        """(item's id, least distance found) for each item that is in `text`, by id, None first."""
        best: dict[int | None, int] = {}
        if not len(self.automaton):  # no items
            return []
        for k, a, b in self._windows(text):
            i, p, edits = self.items[k]
            if best.get(i, edits + 1) and (d := p.distance(text[max(0, a) : max(0, b)])) <= min(edits, best.get(i, edits)):
                best[i] = d
        return sorted(best.items(), key=lambda x: (x[0] is not None, x[0]))


def _item_blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int | None, str]]]:
    """The items, normalised, in lists of about BLOCK_CHARS characters; the driver holds one at a time."""
    block: list[tuple[int | None, str]] = []
    size = 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null").sort("i", "t").toLocalIterator():
        item = normal(r.t)
        if block and size + len(item) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        if item:
            block.append((r.i, item))
            size += len(item)
    if block:
        yield block


def _finds(texts: DataFrame, items: list[tuple[int | None, str]], kind: DataType, error_rate: float, min_chars: int) -> DataFrame:
    """Rows (_key, item, distance) of the items found in rows (_key, text), written; the items' broadcast is gone by then."""
    shared = texts.sparkSession.sparkContext.broadcast(items)
    made: list[Matcher] = []
    item_type = to_arrow_type(kind)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Matcher(shared.value, error_rate, min_chars))
        found = [(k, i, d) for k, t in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist(), strict=True) for i, d in made[0].find(normal(t))]
        keys, ids, distances = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, item_type), pa.array(distances, pa.int32())], names=["_key", "item", "distance"])

    out = materialize(map_arrow(texts, run, f"_key string, item {kind.simpleString()}, distance int", "text"), "finds")
    shared.destroy()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", *, item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.08, min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, *keep, n_items, item_ids, distances, leaked), one for each row of `docs`.

    item_ids are the items that occur in the document within their edit budget,
    ascending, distances their edit distances there.  Items shorter than
    `min_chars` when normalised must occur exactly, as whole words; null and
    blank items match nothing.  Items of one id count as one, with the least
    distance; those without an id count as an item whose id is null, first.
    Null or empty texts match nothing, texts of any length are read whole; ids
    of documents and items may be null, repeated or of any type; other columns are ignored; an empty benchmark leaks
    nowhere.

    The items are read on the driver in blocks of BLOCK_CHARS characters.  Each
    block makes one pass over the documents, after which its broadcast goes.
    """
    fields = [docs.schema[c] for c in (id_col, *keep)]
    # a row's finds depend on its text alone
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    texts = docs.select(key.alias("_key"), F.col(text).alias("text"))
    found, kind = None, benchmark.schema[item_id].dataType
    for block in _item_blocks(benchmark, item_id, item_text):
        part = _finds(texts, block, kind, error_rate, min_chars)
        found = part if found is None else found.unionByName(part)
    named = docs.select(*(F.col(f.name).alias(f"_c{k}") for k, f in enumerate(fields)), key.alias("_key"))
    empty = F.expr("array()").cast(f"array<struct<item:{kind.simpleString()},distance:int>>")
    if found is None:
        joined = named.withColumn("_found", empty)
    else:
        lists = found.groupBy("_key", "item").agg(F.min("distance").alias("distance")).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("item", "distance"))).alias("_found"))
        lists = materialize(lists, "lists")
        joined = named.join(F.broadcast(lists) if lists.count() <= BROADCAST_FINDS else lists, "_key", "left").withColumn("_found", F.coalesce("_found", empty))
    out = joined.select(*(F.col(f"_c{k}").alias(f.name) for k, f in enumerate(fields)), F.col("_found"))
    return out.select(*(f.name for f in fields), F.size("_found").cast("long").alias("n_items"), F.col("_found.item").alias("item_ids"), F.col("_found.distance").alias("distances"), (F.size("_found") > 0).alias("leaked"))

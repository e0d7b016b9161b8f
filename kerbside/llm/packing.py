"""Best-fit packing planned on the histogram of lengths.

Documents become token sequences, those over the capacity are cut, and best fit
(longest first) runs over the counts of each length instead of over documents:
at most `capacity` counts reach the driver, whatever the number of documents.
The plan is a list of slot ranges for each length.  Each piece learns its rank
within its length (its rank within its task, plus the counts of earlier tasks)
and takes the slot of that rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import materialize, slices

CAPACITY = 1024
END_ID = 2
PIECES = "piece int, start long, length long, ids_crc32 long, task long, nth long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole capacities, the first one shorter."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(a, capacity) for a in range(head, n, capacity)]


def plan(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Slots of each length: (first rank, next rank, first sequence, pieces of this length in each sequence, offset of the first).

    Longest lengths first; each piece goes to the open sequence with least
    room that still holds it, else to a new one.
    """
    rooms: list[int] = []  # sorted; with sequences in `open_`
    open_: dict[int, list[tuple[int, int]]] = {}
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room = capacity
                n = -(-left // (capacity // length))
                first, sequences = sequences, sequences + n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.setdefault(length, []).append((rank, rank + full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if full < n and left:
                slots.setdefault(length, []).append((rank, rank + left, first + full, each, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return slots


def tokenized(docs: DataFrame, tokenizer: str, id_col: str, text: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of all documents with their place among the equally long ones of their task."""

    def run(batches):
        encoder = Encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for some in slices(batch, "text"):
                rows: list[tuple] = []
                for i, t in zip(some.column("id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids = np.append(encoder.encode(t or ""), np.uint32(end_id)).astype("<u4")
                    for k, (a, n) in enumerate(cut(len(ids), capacity)):
                        rows.append((i, k, a, n, zlib.crc32(ids[a : a + n].tobytes()), task, int(seen[n])))
                        seen[n] += 1
                columns = list(zip(*rows, strict=True))
                kinds = (some.schema.field("id").type, pa.int32(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {PIECES}")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID, planner: Callable[[dict[int, int], int], dict] = plan) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece.

    A null text is empty and has the end token alone; texts of any length are
    encoded whole, in memory that follows them; ids may be null, repeated or of
    any type (each row is packed; equally long pieces take slots in any order);
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenized(docs, tokenizer, id_col, text, capacity, end_id), "pieces")
    counts = materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = planner(histogram, capacity)
    places = spark.createDataFrame(list(slots.items()), "length long, slots array<struct<a:long,b:long,first:long,each:long,offset:long>>")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before"))
    # at most `capacity` rows, each with the few ranges of one length
    placed = ranked.join(F.broadcast(places), "length").withColumn("slot", F.expr("element_at(filter(slots, s -> rank >= s.a and rank < s.b), 1)"))
    within = F.col("rank") - F.col("slot.a")
    return placed.select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("slot.first") + F.floor(within / F.col("slot.each"))).cast("long").alias("sequence_id"),
        (F.col("slot.offset") + (within % F.col("slot.each")) * F.col("length")).cast("long").alias("offset"),
    )

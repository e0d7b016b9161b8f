"""Near duplicates by SimHash.

A text's fingerprint has 64 bits, each the majority of that bit over the XXH64
of the text's three-word shingles.  Two fingerprints that differ in at most two
bits agree in at least six of their eight bytes, in place: that is the
guaranteed minimum of matches.

An inverted index by byte and position proposes pairs.  The list of one byte
value holds a 256th of all fingerprints, so pairs of such lists grow with the
square of the input.  But six agreeing bytes of eight, taken as four
neighbouring twos, leave at least two twos whole.  So the lists of four
positional bytes that stand for two twos are cut with each other first (six
lists a fingerprint); in what they share, the agreeing positional bytes of each
pair are tallied, pairs below six go, and the bits of the others are counted.

Lists of more than CROWD fingerprints would make too many pairs.  Their members
are linked exactly in another way: two fingerprints differ in at most two bits
if and only if some value is within one bit of both, so each member stands
under its 65 values within one bit and is linked to the smallest member of
each.  That is linear, and drops no link.

Equal fingerprints are one node from the start, so copies are never compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .components import components

#: Fingerprints of a list whose pairs are formed; a member of a longer list has 65 rows instead.
CROWD = 64
#: Bits that may differ, and bytes that must agree then.
BITS, BYTES = 2, 6
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are unpacked at once.
_CHUNK = 1 << 17


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of all shingles of `size` words, repeats included; of the whole sequence if there are fewer words, none without words."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    spaced = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(spaced[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majorities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """int64 [texts]: the bits that more than half of each text's hashes have; 0 for a text without any."""
    count = np.zeros((len(first) - 1, 64), np.int64)
    for a in range(0, len(hashes), _CHUNK):
        b = min(a + _CHUNK, len(hashes))
        bits = np.unpackbits(hashes[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        texts = np.flatnonzero((first[:-1] < b) & (first[1:] > a) & (first[1:] > first[:-1]))
        count[texts] += np.add.reduceat(bits, np.maximum(first[texts] - a, 0), axis=0, dtype=np.int64)
    most = 2 * count > np.diff(first)[:, None]
    return np.packbits(most, axis=1).view(">u8").reshape(-1).astype(np.uint64).view(np.int64)


def _fingerprint(text: str, size: int, seed: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, size, seed) for t in batch.column(text).to_pylist()]
        first = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
        marks = majorities(np.concatenate([np.zeros(0, np.uint64), *hashes]), first)
        kept = [n for n in batch.schema.names if n != text]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(marks)], names=[*kept, "fingerprint"])

    return run


def _twos(mark: F.Column) -> F.Column:
    """Keys of the six lists of a fingerprint: which two of its four twos, and their bytes."""
    keys = []
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        two = [F.shiftrightunsigned(mark, 48 - 16 * k).bitwiseAND(0xFFFF) for k in (i, j)]
        keys.append(F.lit(n << 32).bitwiseOR(F.shiftleft(two[0], 16)).bitwiseOR(two[1]))
    return F.array(*keys)


def agreeing_bytes(a: F.Column, b: F.Column) -> F.Column:
    """Tally of the positions at which two fingerprints have the same byte."""
    unlike = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(unlike, 8 * k).bitwiseAND(0xFF) == 0).cast("int") for k in range(8))


def links(marks: DataFrame) -> DataFrame:
    """Rows (a, b) that join all of the distinct `mark` that links of at most two bits join."""
    listed = marks.select("mark", F.explode(_twos(F.col("mark"))).alias("key"))
    size = listed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    listed = materialize(listed.join(size, "key"), "lists")
    short = listed.where(F.col("size") <= CROWD)
    pairs = short.select("key", F.col("mark").alias("a")).join(short.select("key", F.col("mark").alias("b")), "key").where("a < b")
    tallied = pairs.where(agreeing_bytes(F.col("a"), F.col("b")) >= BYTES)
    verified = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")
    crowded = listed.where(F.col("size") > CROWD).select("mark").distinct()
    # the value itself and those that differ from it in one bit
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)))
    near = crowded.select("mark", F.explode(flips).alias("flip")).select("mark", F.col("mark").bitwiseXOR(F.col("flip")).alias("value"))
    least = near.groupBy("value").agg(F.min("mark").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("value", "b")
    around = near.join(least, "value").where("mark <> b").select(F.col("mark").alias("a"), "b")
    return verified.unionByName(around)


#: Fingerprints that hold this share of all rows, or more, are joined apart: there are at most as many of them.
_HOT = 64


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, shingle: int = 3, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, *keep, fingerprint, component_id, group), one for each row of `docs`.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, A-Z lower-cased;
    shingles have `shingle` of them, repeats counted; a text of fewer words has
    one, its whole sequence.  `fingerprint` (long) has the bits that over half
    of the shingles' XXH64 have; a null or blank text has 0 and is linked like
    any other.  Texts whose fingerprints differ in at most two bits are linked;
    component_id is the smallest id that links reach, the own one included,
    null if no row of the group has an id; `group` numbers the groups of this
    result.  Ids may be null, repeated or of any ordered type; each row counts
    with its own text; other columns are ignored; texts of any length are taken
    whole.  An empty table gives no rows.
    """
    named = {"_id": id_col} | {f"_keep{k}": c for k, c in enumerate(keep)}
    source = docs.select(*(F.col(c).alias(n) for n, c in named.items()), F.col(text).alias("text"))
    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in named.items())
    marked = materialize(map_arrow(source, _fingerprint("text", shingle, seed), f"{kinds}fingerprint long", "text"), "marked")
    marks = materialize(marked.groupBy(F.col("fingerprint").alias("mark")).agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n")), "marks")
    found = components(links(marks)).select(F.col("id").alias("mark"), F.col("component").alias("found"))
    grouped = materialize(marks.join(found, "mark", "left").withColumn("group", F.coalesce("found", "mark")).drop("found"), "grouped")
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    total = marks.agg(F.sum("n")).first()[0] or 0
    node = materialize(grouped.join(least, "group").select(F.col("mark").alias("fingerprint"), "group", "component_id", (F.col("n") * _HOT >= total).alias("hot")), "nodes")
    hot = F.broadcast(node.where("hot").drop("hot"))
    apart = marked.join(hot, "fingerprint")
    rest = marked.join(hot, "fingerprint", "left_anti").join(node.where("not hot").drop("hot"), "fingerprint")
    return apart.unionByName(rest).select(*(F.col(n).alias(c) for n, c in named.items()), "fingerprint", "component_id", "group")

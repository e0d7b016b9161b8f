"""Document fingerprints by I-Match with randomised lexicons.

Terms are runs of letters and digits in lower case.  The lexicon holds the terms
whose inverse document frequency lies in a band; the share of documents that a
term must reach bounds the lexicon's size by the mean number of terms of a
document over that share, whatever the number of documents.  Randomised subsets
of the lexicon are drawn by hashing: five levels of sixteen subsets hold each
term with a chance of 1/16, 1/64, ... 1/4096, so that texts of any length have
subsets of which they hold one or two terms.  A text's
distinct terms are sorted by subset, those of each subset are hashed one after
the other, and the codes of all subsets make the fingerprint.

Everything is DataFrame functions.
"""

from __future__ import annotations

from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Levels of subsets; level k shares one in 4**k of the lexicon's terms out among its subsets.
LEVELS, PER_LEVEL = 5, 16
SUBSETS = LEVELS * PER_LEVEL
CODE = 4
ABSENT = "-" * CODE
#: Terms that a broadcast may hold; a larger lexicon is joined by a shuffle.
BROADCAST_TERMS = 2_000_000
#: Stretches of ids that one pass over neighbours is cut into, at most.
STRETCHES = 10_000
_LEAST = -(1 << 63)


def terms(text: Column) -> Column:
    """64-bit identities of the distinct terms of a text."""
    words = F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, text: str = "text", *, least: float = 0.001, most: float = 0.2) -> DataFrame:
    """Rows (term, level, slot): terms in `least` to `most` of all documents and in two at least, one row for each subset that holds them; each is in one of level 0.

    Repeated rows count as often as they come; null texts are empty ones.
    """
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = counts.where((F.col("df") >= 2) & (F.col("df") >= least * n) & (F.col("df") <= most * n)).select("term")

    # one draw for a term and level, so that a term is in one subset of a level at most
    draw = [F.pmod(F.xxhash64("term", F.lit(k)), F.lit(PER_LEVEL * 4**k)) for k in range(LEVELS)]
    held = F.filter(F.array(*(F.struct(F.lit(k).alias("level"), d.cast("int").alias("slot")) for k, d in enumerate(draw))), lambda x: x["slot"] < PER_LEVEL)
    return materialize(kept.select("term", F.explode(held).alias("s")).select("term", "s.level", "s.slot"), "lexicon")


#: Bits of a term's identity beside the number of its subset.
_TERM_BITS = 56


def spots(known: DataFrame) -> DataFrame:
    """Rows (term, spot) of a lexicon: the subset's number above the term's bits, so that sorted spots are subsets in order with their terms in order."""
    subset = (F.col("level") * PER_LEVEL + F.col("slot")).cast("long")
    return known.select("term", F.shiftleft(subset, _TERM_BITS).bitwiseOR(F.col("term").bitwiseAND(F.lit((1 << _TERM_BITS) - 1))).alias("spot"))


def subset_codes(sorted_spots: Column) -> Column:
    """A fingerprint from a text's sorted spots: one pass that hashes the terms of each subset one after the other; ABSENT for subsets without one."""

    def code(h: Column) -> Column:
        return F.lower(F.lpad(F.hex(F.pmod(h, F.lit(16**CODE))), CODE, "0"))

    def step(state: Column, x: Column) -> Column:
        subset = F.shiftright(x, _TERM_BITS).cast("int")
        same = subset == state["subset"]
        gap = F.repeat(F.lit(ABSENT), subset - state["subset"] - 1)
        begun = F.when(state["subset"] < 0, gap).otherwise(F.concat(state["out"], code(state["hash"]), gap))
        return F.struct(subset.alias("subset"), F.xxhash64(F.when(same, state["hash"]).otherwise(F.lit(0).cast("long")), x).alias("hash"), F.when(same, state["out"]).otherwise(begun).alias("out"))

    start = F.struct(F.lit(-1).alias("subset"), F.lit(0).cast("long").alias("hash"), F.lit("").alias("out"))
    return F.aggregate(sorted_spots, start, step, lambda s: F.concat(s["out"], code(s["hash"]), F.repeat(F.lit(ABSENT), SUBSETS - 1 - s["subset"])))


def codes(fingerprint: Column) -> Column:
    """The codes of all subsets."""
    return F.array(*(F.substring(fingerprint, 1 + k * CODE, CODE) for k in range(SUBSETS)))


def with_likeness(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """`rows` with, for each name, how alike two fingerprint columns are, from 0 to 1: the share of subsets with equal codes
    among those of which either text has a term, over all levels that are not full (the last level where all are); 1 for equal
    fingerprints, 0 where one of two different ones has no lexicon term."""
    columns = sorted({c for p in pairs.values() for c in p})
    out = rows.withColumns({f"_c_{c}": codes(F.col(c)) for c in columns})
    out = out.withColumns({f"_z_{n}": F.zip_with(f"_c_{a}", f"_c_{b}", lambda x, y: F.when((x == ABSENT) & (y == ABSENT), 0).when(x == y, 257).otherwise(256)) for n, (a, b) in pairs.items()})
    # of each level in one sum: 256 for each subset that either has, 1 more for each that is equal
    out = out.withColumns({f"_s_{n}": F.array(*(F.aggregate(F.slice(f"_z_{n}", 1 + k * PER_LEVEL, PER_LEVEL), F.lit(0), lambda s, x: s + x) for k in range(LEVELS))) for n in pairs})
    out = out.withColumns({f"_t_{n}": F.aggregate(F.filter(f"_s_{n}", lambda s: s < 256 * PER_LEVEL), F.lit(0), lambda t, s: t + s) for n in pairs})
    out = out.withColumns({f"_t_{n}": F.when(F.col(f"_t_{n}") > 0, F.col(f"_t_{n}")).otherwise(F.element_at(f"_s_{n}", -1)) for n in pairs})
    for n, (a, b) in pairs.items():
        total = F.floor(F.col(f"_t_{n}") / 256)
        share = F.when(total > 0, (F.col(f"_t_{n}") % 256) / total).otherwise(F.lit(0.0))
        bare = F.startswith(F.col(a), F.lit("=")) | F.startswith(F.col(b), F.lit("="))
        out = out.withColumn(n, F.when(F.col(a) == F.col(b), F.lit(1.0)).when(bare, F.lit(0.0)).otherwise(share))
    return out.select(*rows.columns, *pairs)


def _coded(rows: DataFrame, keys: list[str], keep: list[str], texts: dict[str, str], known: DataFrame) -> DataFrame:
    """`keys` and `keep` of each row and for each of `texts` (output name, text column) its fingerprint.

    A row is told apart by its keys.  The terms of a row stay in its task, so
    where `rows` are dealt by one of the keys nothing is shuffled but the lexicon,
    and that only if it is too large to broadcast.
    """
    marks = F.concat(*(_marked(F.col(c), k) for k, c in enumerate(texts.values())))
    carried = F.struct(*keep, F.array(*(F.xxhash64(c) for c in texts.values())).alias("_whole"))
    long = rows.select(*keys, carried.alias("_row"), F.explode(marks).alias("m"))
    # one of a row's marks carries what else the row has, so that the others are narrow
    long = long.select(*keys, F.when((F.col("m.side") == 0) & (F.col("m.term") == 0), F.col("_row")).alias("_row"), "m.side", "m.term")
    table = known if known.count() > BROADCAST_TERMS else F.broadcast(known)
    got = long.join(table, "term", "inner")
    lists = {f"_l{k}": F.collect_list(F.when((F.col("side") == k) & (F.col("spot") >= 0), F.col("spot"))) for k in range(len(texts))}
    parts = got.groupBy(*keys).agg(F.first("_row", ignorenulls=True).alias("_row"), *(c.alias(n) for n, c in lists.items()))
    out = []
    for k, name in enumerate(texts):
        bare = F.concat(F.lit("="), F.lower(F.hex(F.col("_row._whole")[k])))
        out.append(F.when(F.size(f"_l{k}") == 0, bare).otherwise(subset_codes(F.sort_array(f"_l{k}"))).alias(name))
    return parts.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in keep), *out)


def _marked(text: Column, side: int) -> Column:
    """The terms of a text and 0, which stands for the text itself, each with the text's number."""
    return F.transform(F.concat(terms(text), F.array(F.lit(0).cast("long"))), lambda t: F.struct(F.lit(side).alias("side"), t.alias("term")))


def _with_marker(known: DataFrame) -> DataFrame:
    """The lexicon's spots and term 0, in no subset, so that a text without lexicon terms keeps its row."""
    marker = known.sparkSession.createDataFrame([(0, -1)], "term long, spot long")
    return spots(known.where("term <> 0")).unionByName(marker)


def fingerprint(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id_col, fingerprint), one for each distinct (id, text) of `docs`, with the lexicon `known`.

    A null text is empty, texts of any length are read whole; equal texts have
    equal fingerprints; ids may be null; an empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_at", F.md5("_text")).dropDuplicates(["_id", "_at"])
    return _coded(rows, ["_id", "_at"], [], {"fingerprint": "_text"}, _with_marker(known)).select(F.col("_id").alias(id_col), "fingerprint")


def with_next(docs: DataFrame, id_col: str, text: str, rows_each: int = 2000) -> DataFrame:
    """Rows (stretch, place, last, id, text, next): each document and the next one's text by falling id, the first after the last.

    Ids are cut into stretches of about equal size at approximate quantiles; an
    id that many rows share (null ids do) is cut by its texts' hashes.  Each
    stretch gets one more row, `last`, that repeats the first document of the
    stretch after it, so that neighbours never need one task for all rows.  Null
    ids come last; rows of one id are ordered by their texts' hashes, then texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"k": F.coalesce("id", F.lit(_LEAST)), "h": F.xxhash64("text")})
    n = docs.count()
    parts = max(1, min(STRETCHES, n // rows_each))
    quantiles = docs.select(F.percentile_approx(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)), [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or () if parts > 1 else ()
    # an id at several quantiles is dealt by hash over as many stretches, between those of greater and of smaller ids of its bucket
    shared = {v: m for v, m in Counter(quantiles).items() if m > 1}
    splits = sorted({float(v) for v in quantiles} | {float(v + 1) for v in shared})
    cut = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="d", outputCol="bucket") if splits else None
    dealt = [(splits.index(float(v)) + 1, v, m) for v, m in shared.items()]

    def stretched(frame: DataFrame) -> DataFrame:
        d = frame.withColumn("d", F.col("k").cast("double"))
        bucket = (cut.transform(d) if cut else d.withColumn("bucket", F.lit(0.0))).withColumn("bucket", F.col("bucket").cast("int")).drop("d")
        part = F.lit(0)
        for b, v, m in dealt:
            # hashes rise along the order, stretch numbers fall
            among = F.least(F.lit(m - 1), F.floor((F.col("h") / 2.0**64 + 0.5) * m)).cast("int")
            here = F.when(F.col("k") > v, F.lit(m + 1)).when(F.col("k") == v, m - among).otherwise(F.lit(0))
            part = F.when(F.col("bucket") == b, here).otherwise(part)
        return bucket.withColumn("stretch", F.col("bucket").cast("long") * (STRETCHES + 2) + part).drop("bucket")

    rows = stretched(rows)
    first = rows.groupBy("stretch").agg(F.max(F.struct("k", F.bitwise_not("h").alias("h"))).alias("top"))
    tops = {r.stretch: (r.top.k, ~r.top.h) for r in first.collect()}  # at most twice STRETCHES rows
    order = sorted(tops, reverse=True)  # stretches by falling id
    after = [(*tops[order[(i + 1) % len(order)]], b) for i, b in enumerate(order)]
    targets = F.broadcast(docs.sparkSession.createDataFrame(after, "k long, h long, to long"))
    best = Window.partitionBy("to").orderBy("text")
    heads = rows.join(targets, ["k", "h"]).withColumn("r", F.row_number().over(best)).where("r = 1").select("id", "text", "k", "h", F.col("to").alias("stretch"), F.lit(True).alias("last"))
    both = rows.select("id", "text", "k", "h", "stretch", F.lit(False).alias("last")).unionByName(heads)
    falling = Window.partitionBy("stretch").orderBy("last", F.col("k").desc(), "h", "text")
    return both.select("stretch", F.row_number().over(falling).alias("place"), "last", "id", "text", F.lead("text").over(falling).alias("next"))


def compare_with_edits(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one for each row of `docs`.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document by falling id, the first after
    the last; see `with_next` on null and repeated ids, which must be whole
    numbers, as they are told by size.  A null text is empty,
    texts of any length are read whole, other columns are ignored.  An empty
    table gives no rows.
    """
    rows = with_next(docs, id_col, text)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third)))
    rows = rows.select("stretch", "place", "last", "id", n.cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"), "text", "edited")
    coded = _coded(rows, ["stretch", "place"], ["last", "id", "n_chars", "sha"], {"fingerprint": "text", "edited_fingerprint": "edited"}, _with_marker(known))
    falling = Window.partitionBy("stretch").orderBy("place")
    coded = coded.withColumn("next_fingerprint", F.lead("fingerprint").over(falling)).where(~F.col("last"))
    alike = with_likeness(coded, {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")})
    return alike.select(F.col("id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")

"""A trigram language model in Elias-Fano tries, dealt over shards.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, known by 64-bit identities;
each text ends with one end token, which is also what stands before its first
word.  The model is an add-one unigram, a bigram smoothed around it and a trigram
smoothed around that, by Dirichlet priors of weight MU and MU3:

    P1(w) = (c(w) + 1) / (N + V + 1)
    P2(w | h) = (c(h w) + MU * P1(w)) / (c(h) + MU)
    P3(w | g h) = (c(g h w) + MU3 * P2(w | h)) / (c(g h) + MU3)

P3 holds where h makes at least FREQUENT of all training tokens (there are at
most 1 / FREQUENT such words, which are known everywhere with their counts) and
is no end; behind rarer words and at a text's begin it is P2, whose context is
specific there already.  In logarithms

    log P2 = log P1(w) + G2(h w) + B2(h),   log P3 = log P2 + G3(g h w) + B3(g h)

with gains G2 = log(1 + c(h w) / (MU * P1(w))), G3 = log(1 + c(g h w) / (MU3 * P2(w | h))),
0 for what was never seen, and back-offs B2 = log(MU / (c(h) + MU)),
B3 = log(MU3 / (c(g h) + MU3)).  Each token but a text's last is the context of
exactly one token, so a text's score is the sum over its tokens w of log P1(w),
G2, G3, B2(w) and B3 of the pair that ends in w: all that a token needs is kept
with the word w.

Each shard holds the words that hash to it as a trie.  Level one: identities of
words and, per word, a pointer to its contexts.  Level two: for each word, in
order, the words h seen before it, relative to the word, with quantised gains
and back-offs, and pointers on.  Level three: for each pair, in order, the words
g seen before it, relative to the pair, with quantised gains.  What is monotone
is Elias-Fano coded.  A token is looked up by successor search in its word's
range, then in its pair's.  The levels are written to a file that is mapped
into memory while the shard's texts are scored.

Texts are tokenised in blocks.  A block sends each shard its tokens of that
shard; the shard counts those of training texts, builds its trie, scores all,
and returns sums for each text of the block.  Words with a large share of all
tokens would make a shard hot: their pairs are dealt over all shards by context,
and what else they need is known everywhere.  What is sent grows with the input;
there are as many shards as keep each at about SHARD_TOKENS, however long the
input is.
"""

from __future__ import annotations

import math
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, slices
from .elias_fano import EliasFano
from .hashing import mix, words

MU, MU3 = 1000.0, 20.0
#: Share of the training tokens from which a word's pairs are dealt by context, and from which trigrams are kept behind a word.
HOT_SHARE, FREQUENT = 0.001, 1e-5
#: Tokens of a shard, and characters that a token takes at least on average, to plan shards by.
SHARD_TOKENS, TOKEN_CHARS = 2_000_000, 5
#: Tokens of a block.
BLOCK_TOKENS = 1_000_000
#: The end token's identity.
END = np.uint64(0x0E2D0F7E87000001)
#: Gains are kept in steps of 1 / STEPS decades.
STEPS = 4096.0
_U = np.uint64
_LOW31, _LOW32, _KNOWN = _U(0x7FFFFFFF), _U(0xFFFFFFFF), _U(0x80000000)


def _dump(what: dict) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(what, protocol=5))


def _load(data: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with ends, what stands before each, and the number of tokens of each text."""
    ids, first = words(texts)
    count = np.diff(first) + 1
    out = np.full(len(ids) + len(texts), END, np.uint64)
    end = np.cumsum(count) - 1
    body = np.ones(len(out), bool)
    body[end] = False
    out[body] = ids
    before = np.concatenate([[END], out[:-1]]) if len(out) else out
    return out, before, count


def _find(values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in sorted values, and whether they are there."""
    if not len(values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.searchsorted(values, x).clip(0, len(values) - 1)
    return at, values[at] == x


class Frequent:
    """The words known everywhere, with their counts; those from `hot` counts on are hot."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, hot: float) -> None:
        order = np.argsort(ids)
        self.ids, self.counts = ids[order], counts[order]
        big = self.counts >= hot
        self.hot, self.hot_counts = self.ids[big], self.counts[big]

    def contexts(self, h: np.ndarray) -> np.ndarray:
        """Contexts on 32 bits: the place of a frequent word and a mark, or 31 bits of any other; an end is no frequent context."""
        at, known = _find(self.ids, h)
        return np.where(known & (h != END), at.astype(np.uint64) | _KNOWN, h & _LOW31).astype(np.uint32)


def _shard(w: np.ndarray, h: np.ndarray, hot: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each token; whether its word is hot."""
    is_hot = np.isin(w, hot)
    key = np.where(is_hot, mix(w ^ mix(h)), w)
    return (mix(key ^ _U(0x51AFD)) % _U(shards)).astype(np.int32), is_hot


class Trie:
    """The words of a shard, their counts, the contexts h seen before them, and the g seen before those pairs."""

    LEVELS = ("words", "pointers", "contexts", "pointers3", "contexts3")

    def __init__(self, levels: dict[str, np.ndarray]) -> None:
        self.levels = levels

        def level(name: str) -> EliasFano:
            return EliasFano(*(levels[f"{name}.{k}"] for k in EliasFano.NAMES))

        self.words, self.pointers, self.contexts, self.pointers3, self.contexts3 = map(level, self.LEVELS)
        self.counts, self.gains, self.backs, self.gains3 = (levels[k] for k in ("counts", "gains", "backs", "gains3"))

    @classmethod
    def build(cls, ids: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray, before: np.ndarray, total: float, mu: float, mu3: float) -> Trie:
        """ids: sorted words, counts: of each; pairs: sorted (word's place << 32 | context), pair_counts: of each; triples: sorted (pair's place << 32 | context before), triple_counts: of each; before: counts of frequent words; total: N + V + 1."""
        place = (pairs >> _U(32)).astype(np.int64)
        prior = mu * (counts[place] + 1.0) / total
        pair = (triples >> _U(32)).astype(np.int64)
        h = pairs[pair] & _LOW31
        second = (pair_counts[pair] + prior[pair]) / (before[h.astype(np.int64)] + mu) if len(pair) else np.zeros(0)

        def quantised(x: np.ndarray) -> np.ndarray:
            return np.minimum(np.rint(x * STEPS), 65535).astype(np.uint16)

        levels = {"counts": counts.astype(np.int64), "gains": quantised(np.log10(1.0 + pair_counts / prior)), "backs": quantised(np.log10(1.0 + pair_counts / mu3)), "gains3": quantised(np.log10(1.0 + triple_counts / (mu3 * second)))}
        pointers, pointers3 = (np.searchsorted(of, np.arange(n + 1)).astype(np.uint64) for of, n in ((place, len(ids)), (pair, len(pairs))))
        for name, values in zip(cls.LEVELS, (ids, pointers, pairs, pointers3, triples), strict=True):
            levels |= {f"{name}.{k}": v for k, v in EliasFano.build(values).parts().items()}
        return cls(levels)

    def mapped(self) -> Trie:
        """The same trie in a file mapped into memory; the file has no name and goes with the trie."""
        file = tempfile.TemporaryFile()
        places, at = {}, 0
        for k, v in self.levels.items():
            file.write(np.ascontiguousarray(v).tobytes())
            places[k] = (at, v.dtype, len(v))
            pad = -v.nbytes % 8
            file.write(b"\0" * pad)
            at += v.nbytes + pad
        file.flush()
        whole = np.memmap(file, np.uint8, "r") if at else np.zeros(0, np.uint8)
        file.close()
        return Trie({k: whole[a : a + n * d.itemsize].view(d) for k, (a, d, n) in places.items()})

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Places of words; -1 where unknown."""
        at, known = self.words.successor(ids)
        return np.where(known, at, -1)

    @staticmethod
    def _below(place: np.ndarray, context: np.ndarray, pointers: EliasFano, contexts: EliasFano) -> np.ndarray:
        """Places on the next level of each (place, context); -1 where that was never seen."""
        out = np.full(len(place), -1, np.int64)
        some = np.flatnonzero(place >= 0)
        if len(some) and contexts.n:
            keys, back = np.unique(place[some].astype(np.uint64) << _U(32) | context[some].astype(np.uint64), return_inverse=True)
            p = (keys >> _U(32)).astype(np.int64)
            at, seen = contexts.successor(keys, pointers.get(p), pointers.get(p + 1))
            out[some] = np.where(seen, at, -1)[back]
        return out

    def pairs(self, place: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Places of (word's place, h)."""
        return self._below(place, h, self.pointers, self.contexts)

    def triples(self, pair: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Places of (pair's place, g)."""
        return self._below(pair, g, self.pointers3, self.contexts3)


def _value(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Quantised values at places, 0 at -1."""
    return np.where(at >= 0, values[np.maximum(at, 0)], 0) / STEPS if len(values) else np.zeros(len(at))


def _blocks(batches, function) -> Iterator[pa.RecordBatch]:
    """Hand `function` blocks of rows (ids, held, texts' tokens) of about BLOCK_TOKENS tokens, numbered for the task."""
    task, k = TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for some in slices(batch, "text"):
            w, h, count = _tokens(some.column("text").to_pylist())
            rows.append((some.column("id"), some.column("held").to_pylist(), w, h, count))
            size += len(w)
            if size >= BLOCK_TOKENS:
                yield from function((task << 32) | k, *_joined(rows))
                rows, size, k = [], 0, k + 1
    if rows:
        yield from function((task << 32) | k, *_joined(rows))


def _joined(rows: list[tuple]) -> tuple:
    ids, held, w, h, count = zip(*rows, strict=True)
    return pa.concat_arrays(ids), np.array([bool(x) for y in held for x in y], bool), np.concatenate(w), np.concatenate(h), np.concatenate(count)


_SENT = "shard int, block long, data binary"


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, block, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], names=["shard", "block", "data"])


def _count_words(shards: int):
    """Blocks of training texts -> for each shard its words and their counts."""

    def block(number, ids, held, w, h, count):
        known, n = np.unique(w, return_counts=True)
        shard = (mix(known ^ _U(0x51AFD)) % _U(shards)).astype(np.int32)
        yield _sent([(int(s), number, _dump({"w": known[shard == s], "n": n[shard == s].astype(np.uint32)})) for s in np.unique(shard)])

    return lambda batches: _blocks(batches, block)


def _merge_words(group: pa.Table) -> pa.Table:
    parts = [_load(x.as_py()) for x in group.column("data")]
    ids, back = np.unique(np.concatenate([p["w"] for p in parts]), return_inverse=True)
    n = np.bincount(back, np.concatenate([p["n"] for p in parts])).astype(np.int64)
    often = n >= FREQUENT * n.sum()  # at most 1 / FREQUENT words of the shard
    return pa.table({"words": [len(ids)], "tokens": [int(n.sum())], "often": pa.array([ids[often].view(np.int64).tolist()], pa.list_(pa.int64())), "often_n": pa.array([n[often].tolist()], pa.list_(pa.int64()))})


def _send(shards: int, frequent: Frequent, total: float, mu: float):
    """Blocks of all texts -> for each shard its tokens; one of them also takes what hot words add and what each text is."""

    def block(number, ids, held, w, h, count):
        texts = len(count)
        shard, is_hot = _shard(w, h, frequent.hot, shards)
        owner = np.repeat(np.arange(texts), count)
        at, _ = _find(frequent.hot, w[is_hot])
        n = frequent.hot_counts[at] if len(frequent.hot) else np.zeros(0)
        base = np.bincount(owner[is_hot], np.log10((n + 1.0) / total), texts).astype(float)
        score = base + np.bincount(owner[is_hot], np.log10(mu / (n + mu)), texts).astype(float)
        head = {"ids": ids, "held": held, "count": count.astype(np.uint32), "base": base, "score": score, "known": np.bincount(owner[is_hot], minlength=texts).astype(np.uint32)}
        before = frequent.contexts(h)
        third = before >= _KNOWN
        # what stands before a token's context; asked for where the context is no end, so never at a text's begin
        g = (np.concatenate([[END], h[:-1]]) & _LOW32).astype(np.uint32) if len(h) else before
        order = np.argsort(shard.astype(np.uint16) if shards <= 65535 else shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        main = number % shards
        train = np.packbits(~held)
        for s in sorted({*np.unique(shard).tolist(), main}):
            mine = order[ends[s] : ends[s + 1]]
            known, place = np.unique(w[mine], return_inverse=True)
            sent = {"w": known, "i": place.astype(np.uint16 if len(known) <= 65535 else np.uint32), "h": before[mine], "g": g[mine][third[mine]], "texts": np.bincount(owner[mine], minlength=texts).astype(np.uint16 if count.max() <= 65535 else np.uint32), "train": train}
            yield _sent([(s, number, _dump(sent | ({"head": head} if s == main else {})))])

    return lambda batches: _blocks(batches, block)


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _build(data, frequent: Frequent, total: float, mu: float, mu3: float) -> Trie:
    """The trie of a shard's training tokens."""

    def training():
        for x in data:
            p = _load(x.as_py())
            took = np.repeat(np.unpackbits(p["train"], count=len(p["texts"])).astype(bool), p["texts"])
            yield p, took

    known = np.unique(np.concatenate([p["w"][np.unique(p["i"][took])] for p, took in training()]))

    def pairs_of(p, took):
        return np.searchsorted(known, p["w"]).astype(np.uint64)[p["i"][took]] << _U(32) | p["h"][took]

    pairs, n = _counted([pairs_of(p, took) for p, took in training()])
    keys = []
    for p, took in training():
        third = p["h"] >= _KNOWN
        both = (took & third)[third]
        of = pairs_of(p, took)[third[took]]
        keys.append(np.searchsorted(pairs, of).astype(np.uint64) << _U(32) | p["g"][both])
    triples, n3 = _counted(keys)
    counts = np.bincount((pairs >> _U(32)).astype(np.int64), n, len(known)).astype(np.int64)
    at, hot = _find(frequent.hot, known)
    counts[hot] = frequent.hot_counts[at[hot]]
    return Trie.build(known, counts, pairs, n, triples, n3, frequent.counts, total, mu, mu3)


def _score(frequent: Frequent, total: float, mu: float, mu3: float):
    """All blocks' tokens of one shard -> for each block sums of its texts."""

    def run(group: pa.Table) -> pa.Table:
        data = group.column("data")
        trie = _build(data, frequent, total, mu, mu3).mapped()
        out = []
        for number, x in zip(group.column("block").to_pylist(), data, strict=True):
            p = _load(x.as_py())
            place = trie.find(p["w"])
            c = np.where(place >= 0, trie.counts[np.maximum(place, 0)] if len(trie.counts) else 0, 0)
            cold = ~np.isin(p["w"], frequent.hot)
            base = np.where(cold, np.log10((c + 1.0) / total), 0.0)
            back = np.where(cold, np.log10(mu / (c + mu)), 0.0)
            opens = _find(frequent.ids, p["w"])[1] & (p["w"] != END)
            i = p["i"]
            pair = trie.pairs(place[i], p["h"])
            gain = _value(trie.gains, pair) - np.where(opens[i], _value(trie.backs, pair), 0.0)
            third = p["h"] >= _KNOWN
            gain[third] += _value(trie.gains3, trie.triples(pair[third], p["g"]))
            some = np.flatnonzero(p["texts"])
            first = np.concatenate([[0], np.cumsum(p["texts"][some])[:-1]]).astype(np.int64)

            def sums(values: np.ndarray) -> np.ndarray:
                return np.add.reduceat(values, first) if len(some) else np.zeros(0)

            plain = sums(base[i])
            out.append((number, _dump({"at": some.astype(np.uint32), "base": plain, "score": plain + sums(back[i] + gain), "known": sums(((c > 0) & cold)[i].astype(np.int64)).astype(np.uint32), "head": p.get("head")})))
        number, packed = zip(*out, strict=True)
        return pa.table({"block": pa.array(number, pa.int64()), "data": pa.array(packed, pa.binary())})

    return run


def _gather(tokens: int, kind: pa.DataType):
    """All shards' sums of one block -> its texts."""

    def run(group: pa.Table) -> pa.Table:
        parts = [_load(x.as_py()) for x in group.column("data")]
        head = next(p["head"] for p in parts if p["head"])
        base, score, known = head["base"].copy(), head["score"].copy(), head["known"].astype(np.int64)
        for p in parts:
            base[p["at"]] += p["base"]
            score[p["at"]] += p["score"]
            known[p["at"]] += p["known"]
        texts = len(base)
        return pa.table({"id": head["ids"].cast(kind), "held_out": pa.array(head["held"]), "n_tokens": pa.array(head["count"].astype(np.int64)), "n_known": pa.array(known), "train_tokens": pa.array(np.full(texts, tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def score_texts(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text: str = "text", *, mu: float = MU, mu3: float = MU3, shards: int | None = None) -> DataFrame:
    """Rows (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of `docs`.

    The model learns from all rows where `held_out` is false; repeated rows
    count as often as they come.  base_score is the sum of log10 P1, score of
    log10 P, over the words and the end of a text.  A null text is empty and has
    the end alone, texts of any length are scored whole; ids may be of any type,
    null or repeated; other columns are ignored.  Without training rows N is 0
    and both scores are those of add-one smoothing of nothing.
    """
    spark = docs.sparkSession
    least = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0] / TOKEN_CHARS
    shards = shards or max(least, math.ceil(size / SHARD_TOKENS))
    blocks = max(least, math.ceil(size / BLOCK_TOKENS / 8))
    kind = docs.schema[id_col].dataType
    first = rows.where("not held").mapInArrow(_count_words(shards), _SENT).repartitionById(shards, "shard")  # a shard is a task
    counted = materialize(first.groupBy("shard").applyInArrow(_merge_words, "words long, tokens long, often array<long>, often_n array<long>"), "words")
    tokens, distinct = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    # at most 1 / FREQUENT words in all
    often = counted.select(F.inline(F.arrays_zip("often", "often_n"))).where(F.col("often_n") >= FREQUENT * max(tokens, 1)).collect()
    frequent = Frequent(np.array([r.often for r in often], np.int64).view(np.uint64), np.array([r.often_n for r in often], np.int64), HOT_SHARE * max(tokens, 1))
    total = float(tokens + distinct + 1)
    sent = rows.mapInArrow(_send(shards, frequent, total, mu), _SENT).repartitionById(shards, "shard")
    sums = sent.groupBy("shard").applyInArrow(_score(frequent, total, mu, mu3), "block long, data binary")
    out = sums.repartition(blocks, "block").groupBy("block").applyInArrow(_gather(tokens, to_arrow_type(kind)), f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)

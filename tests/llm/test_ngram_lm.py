import collections
import datetime
import decimal
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbside.llm import ngram_lm
from kerbside.llm.common import fold
from kerbside.llm.elias_fano import EliasFano
from kerbside.llm.ngram_lm import FREQUENT, MU, MU3, Trie, score_texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=200), st.lists(st.integers(0, 2**63), min_size=1, max_size=40))
def test_elias_fano(values, queries):
    v = np.sort(np.array(values, np.uint64))
    e = EliasFano.build(v)
    assert (e.get(np.arange(len(v))) == v).all()
    q = np.array(queries + values, np.uint64)
    at, equal = e.successor(q)
    assert (at == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()
    if len(v) > 2:
        first, last = np.zeros(len(q), np.int64) + 1, np.full(len(q), len(v) - 1)
        at, equal = e.successor(q, first, last)
        assert (at == 1 + np.searchsorted(v[1:-1], q)).all() and (equal == np.isin(q, v[1:-1])).all()


def test_mapped_trie_is_the_same():
    ids = np.array([5, 9, 2**60], np.uint64)
    known = 1 << 31
    pairs = np.array([0 << 32 | 7, 0 << 32 | known, 2 << 32 | 7], np.uint64)
    triples = np.array([1 << 32 | 4, 1 << 32 | 6], np.uint64)
    t = Trie.build(ids, np.array([3, 1, 2]), pairs, np.array([2, 2, 2]), triples, np.array([1, 1]), np.array([6]), 9.0, 10.0, 2.0)
    m = t.mapped()
    q = np.array([5, 6, 9, 2**60], np.uint64)
    assert m.find(q).tolist() == t.find(q).tolist() == [0, -1, 1, 2]
    place, context = np.array([0, 0, 1, 2, -1, 0]), np.array([7, 8, 7, 7, 7, known], np.uint32)
    assert m.pairs(place, context).tolist() == t.pairs(place, context).tolist() == [0, -1, -1, 2, -1, 1]
    assert m.triples(np.array([1, 1, 0, -1, 1]), np.array([4, 5, 4, 4, 6], np.uint32)).tolist() == [0, -1, -1, -1, 1]
    assert (m.gains > 0).all() and (m.backs > 0).all() and (m.gains3 > 0).all()


def brute(rows, mu, mu3=MU3, frequent=FREQUENT):
    word = re.compile(rb"[^\x20\x09-\x0d]+")
    tokens = [[*word.findall((t or "").encode().lower()), None] for _, t, _ in rows]
    c, pairs, triples, before = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for w, (_, _, held) in zip(tokens, rows, strict=True):
        if not held:
            c.update(w)
            pairs.update(zip([None, *w[:-1]], w, strict=True))
            triples.update(zip([None, *w[:-2]], w[:-1], w[1:], strict=False))
            before.update(zip([None, *w[:-2]], w[:-1], strict=False))
    n, z = sum(c.values()), sum(c.values()) + len(c) + 1

    def probability(g, h, w):
        second = (pairs[h, w] + mu * (c[w] + 1) / z) / (c[h] + mu)
        if h is None or c[h] < max(frequent * n, 1):
            return second
        return (triples[g, h, w] + mu3 * second) / (before[g, h] + mu3)

    out = []
    for w, (i, _, held) in zip(tokens, rows, strict=True):
        base = sum(math.log10((c[x] + 1) / z) for x in w)
        score = sum(math.log10(probability(*x)) for x in zip([None, None, *w[:-2]][: len(w)], [None, *w[:-1]], w, strict=True))
        out.append((i, held, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 3e-4 * w[2]


def test_sample_against_brute_force(sample):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in sample.collect()]
    same(score_texts(sample, fold("doc_id") % 7 == 2).collect(), brute(rows, MU))


def test_edge_cases(docs, empty):
    held = F.col("doc_id") % 2 == 1
    rows = [(r.doc_id, r.text, bool(r.doc_id is not None and r.doc_id % 2 == 1)) for r in docs.collect()]
    same(score_texts(docs, held, mu=50.0, shards=3).collect(), brute(rows, 50.0))
    assert score_texts(empty, held).collect() == []


@pytest.mark.parametrize("share", [1e-3, 0.05])
def test_rarer_contexts_back_off_to_pairs(sample, monkeypatch, share):
    monkeypatch.setattr(ngram_lm, "FREQUENT", share)
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in sample.collect()]
    same(score_texts(sample, fold("doc_id") % 7 == 2, shards=11).collect(), brute(rows, MU, frequent=share))


def test_probabilities_sum_to_one(spark):
    """Over all words and the end, known and one unknown, after any two words."""
    train, prefixes, after = ["a b a b c", "a b d", "c a b a", "b b b"], ["a b", "b a", "c", "z a", "a z"], ["a", "b", "c", "d", "unknown", ""]
    texts = {f"{p} {w}".strip() for p in prefixes for w in after}
    rows = [(t, t, False) for t in train] + [("held " + t, t, True) for t in texts]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows, "doc_id string, text string, h boolean"), F.col("h"), mu=3.0, mu3=2.0, shards=2).collect()}
    for p in prefixes:
        # the probability of going on with a word is that of a text that ends there, without its end
        total = sum(10 ** got[f"held {p} {w}".strip()] / (ending(train, f"{p} {w}".split()) if w else 1.0) for w in after)
        assert total / prefix(train, p.split()) == pytest.approx(1.0, abs=0.01)


def ending(train, words):
    rows = [(0, t, False) for t in train] + [(1, " ".join(words), True)]
    return 10 ** (brute(rows, 3.0, 2.0)[-1][6] - prefix_log(train, words))


def prefix_log(train, words):
    """log10 of the probability of the words without an end."""
    word = [[*t.encode().split(), None] for t in train]
    c, pairs, triples = collections.Counter(x for w in word for x in w), collections.Counter(), collections.Counter()
    for w in word:
        pairs.update(zip([None, *w[:-1]], w, strict=True))
        triples.update(zip([None, *w[:-2]], w[:-1], w[1:], strict=False))
    z, out, g, h = sum(c.values()) + len(c) + 1, 0.0, None, None
    for w in (x.encode() for x in words):
        second = (pairs[h, w] + 3.0 * (c[w] + 1) / z) / (c[h] + 3.0)
        after = sum(v for k, v in triples.items() if k[:2] == (g, h))
        out += math.log10(second if h is None or not c[h] else (triples[g, h, w] + 2.0 * second) / (after + 2.0))
        g, h = h, w
    return out


def prefix(train, words):
    return 10 ** prefix_log(train, words)


@pytest.mark.parametrize("kind,value", [("decimal(20,0)", decimal.Decimal(7)), ("double", 7.5), ("boolean", True), ("date", datetime.date(2024, 1, 2)), ("short", 7), ("struct<a:int>", (7,))])
def test_ids_of_any_type(spark, kind, value):
    out = score_texts(spark.createDataFrame([(value, "a b", 1), (None, None, 2)], f"doc_id {kind}, text string, head int"), F.lit(False)).collect()
    assert sorted(r.n_tokens for r in out) == [1, 3] and [r.doc_id for r in out if r.n_tokens == 3] == [value]


def test_nothing_learned(docs):
    out = score_texts(docs, F.lit(True)).collect()
    assert len(out) == docs.count() and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 == r.score for r in out)

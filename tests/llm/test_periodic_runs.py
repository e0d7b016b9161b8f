import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm import periodic_runs as module
from kerbside.llm.periodic_runs import next_smaller, periodic_runs, range_minima, runs, suffix_ranks
from kerbside.llm.queries import op11_periodic_runs


def plain(w, least=6, periods=4):
    """Runs by comparing each word with those a period later."""
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - start + q
            if i > start and n >= max(least, periods * q) and not any(a <= start and a + b >= start + n for a, b, _ in out):
                out.append((start, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


blocks = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 8)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(blocks, max_size=4), st.sampled_from([0, 256]), st.sampled_from([1, 3, 24]))
def test_runs_equal_the_plain_ones(shapes, few, ahead):
    texts = [[x for b, n in shape for x in b * n] for shape in shapes]
    ids = np.array([x for t in texts for x in t], np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    was = module._FEW, module._AHEAD
    module._FEW, module._AHEAD = few, ahead
    try:
        got = [tuple(r) for r in runs(ids, first).tolist()]
    finally:
        module._FEW, module._AHEAD = was
    assert got == [(k, *r) for k, t in enumerate(texts) for r in plain(t)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_suffix_array_next_smaller_and_minima(w):
    n = len(w)
    sa, rank = suffix_ranks(np.array(w), np.full(n, n))
    assert sa.tolist() == sorted(range(n), key=lambda i: w[i:])
    assert next_smaller(rank).tolist() == [next((j for j in range(i + 1, n) if rank[j] < rank[i]), n) for i in range(n)]
    pairs = [(a, b) for a in range(n) for b in range(a, n)]
    got = range_minima(np.array(w), np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [min(w[a : b + 1]) for a, b in pairs]


def test_long_periods_and_a_very_long_text():
    for w in (np.zeros(200_000, np.int64), np.append(1, np.zeros(50_000, np.int64)), np.tile(np.arange(9_000), 12)):
        (found,) = runs(w, np.array([0, len(w)])).tolist()
        assert found[1:] == ([0, len(w), 9_000] if w[-1] else [int(w[0]), len(w) - int(w[0]), 1])


def test_edge_cases(spark, docs):
    """Nulls, blanks, ties, repeated rows, clashing columns and a long text of one word."""
    out = periodic_runs(docs.withColumnRenamed("bands", "runs").withColumn("collapsed", docs.score), keep=("doc_id", "runs")).collect()
    assert len(out) == docs.count()
    for r, d in zip(sorted(out, key=str), sorted(docs.collect(), key=str), strict=False):
        assert r.n_words >= 0
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    long = next(r for r in out if r.n_words == 3000)
    assert [tuple(x) for x in long[3]] == [(0, 3000, 1)] and long[4] == "word"
    assert by_id[4][3] == [] and by_id[4][4] == ""


def test_empty(empty):
    assert periodic_runs(empty).collect() == [] and periodic_runs(empty).columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("d1", "a b " * 5), (None, "x"), ("d1", None)], "doc_id string, text string")
    assert {(r.doc_id, r.collapsed, len(r.runs)) for r in periodic_runs(df).collect()} == {("d1", "a b", 1), (None, "x", 0), ("d1", "", 0)}


def test_fewer_periods_than_the_method_takes(docs):
    with pytest.raises(ValueError):
        periodic_runs(docs, min_periods=2)


def test_the_whole_sample_against_the_contract(spark, sample):
    got = {r.doc_id: r for r in op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    for d in sample.collect():
        w = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = plain(w)
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        r = got[d.doc_id]
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else None
        assert (r.n_runs, (r.start, r.length, r.period, r.exponent_milli)) == (len(want), (*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()

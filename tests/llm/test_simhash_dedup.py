import itertools
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm import simhash_dedup
from kerbside.llm.components import components
from kerbside.llm.queries import op13_simhash_dedup
from kerbside.llm.simhash_dedup import agreeing_bytes, links, majorities, shingle_hashes, simhash_groups


def mark(text):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(marks):
    """Component of each number by all pairs."""
    parent = {m: m for m in marks}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {m: root(m) for m in parent}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aBc \n\x0bé", max_size=30), max_size=6), st.sampled_from([1, 3, 1 << 17]))
def test_fingerprints_follow_the_rule(texts, chunk):
    import numpy as np

    hashes = [shingle_hashes(t) for t in texts]
    was, simhash_dedup._CHUNK = simhash_dedup._CHUNK, chunk
    try:
        got = majorities(np.concatenate([np.zeros(0, np.uint64), *hashes]), np.cumsum([0, *map(len, hashes)]))
    finally:
        simhash_dedup._CHUNK = was
    assert [int(x) & (1 << 64) - 1 for x in got] == [mark(t) for t in texts]


@pytest.mark.parametrize("crowd", [1, 5, 64, 10_000])
def test_links_join_what_all_pairs_join(spark, monkeypatch, crowd):
    """Clouds of numbers around few centres, whose lists are long, and single ones."""
    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    rnd = random.Random(crowd)
    marks = {rnd.getrandbits(64) for _ in range(50)} | {0, 1 << 63, 3, (1 << 64) - 1}
    for _ in range(4):
        centre, loose = rnd.getrandbits(64), [1 << k for k in rnd.sample(range(64), 9)]
        marks |= {centre ^ sum(rnd.sample(loose, rnd.randint(0, 9))) for _ in range(60)}
    want = brute(marks)
    frame = spark.createDataFrame([(signed(m),) for m in marks], "mark long")
    edges = links(frame)
    assert all((r.a ^ r.b & (1 << 64) - 1).bit_count() <= 2 or ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
    label = {r.id: r.component for r in components(edges).collect()}
    groups = {}
    for m in marks:
        groups.setdefault(label.get(signed(m), signed(m)), set()).add(m)
    plain = {}
    for m, r in want.items():
        plain.setdefault(r, set()).add(m)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_tally_of_bytes(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0, 8), (0, -1, 0), (0x0102, 0x0202, 7), (-1, 0x00FFFFFFFFFFFFFF, 7)]
    df = spark.createDataFrame(rows, "a long, b long, n int").select(agreeing_bytes(F.col("a"), F.col("b")).alias("got"), "n")
    assert all(r.got == r.n for r in df.collect())


def test_whole_sample_against_all_pairs(spark, sample):
    texts = {r.doc_id: mark(r.text) for r in sample.collect()}
    group = brute(texts.values())
    least = {}
    for i, m in sorted(texts.items()):
        least.setdefault(group[m], i)
    got = {tuple(r) for r in op13_simhash_dedup(spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint", "component_id").collect()}
    assert got == {(i, f"{m:016x}", least[group[m]]) for i, m in texts.items()}


def test_edge_cases(spark, docs):
    """Nulls, blanks and repeated rows; names that clash with results; rows without an id take part."""
    out = simhash_groups(docs.withColumnRenamed("bands", "fingerprint").withColumnRenamed("score", "group"), keep=("group",)).collect()
    assert len(out) == docs.count()
    zero = [r for r in out if r[2] == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {3}
    assert {r.component_id for r in out if r.doc_id == 2} == {0} or {r.component_id for r in out if r.doc_id == 2} == {2}


def test_empty_and_ids_of_any_type(spark, empty):
    assert simhash_groups(empty).collect() == []
    df = spark.createDataFrame([("b", "x y z"), ("a", "X  y z"), (None, "x y z"), (None, "q r s t")], "doc_id string, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash_groups(df).collect()) == [("None", "None"), ("None", "a"), ("a", "a"), ("b", "a")]

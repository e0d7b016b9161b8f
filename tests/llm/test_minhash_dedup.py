import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm import minhash_dedup
from kerbside.llm.hashing import shingles, words
from kerbside.llm.minhash_dedup import block_links, near_duplicates, signatures


def plain_set(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: plain_set(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\t\x0bé", max_size=40), max_size=6))
def test_words_follow_the_rule(texts):
    ids, first = words(texts)
    got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    want = [t.encode().lower().split() for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    seen = {}
    for g, w in zip(itertools.chain(*got), itertools.chain(*want), strict=True):
        assert seen.setdefault(w, g) == g
    assert len(set(seen.values())) == len(seen)


def test_shingles_of_short_and_long_texts():
    ids, first = shingles(["a b c d e f", "a b", "", None, "a b c d e"])
    assert np.diff(first).tolist() == [2, 1, 0, 0, 1]
    assert ids[0] == ids[-1]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**63, 3000, dtype=np.uint64), rng.integers(0, 2**63, (2, 500), dtype=np.uint64)
    ids = np.concatenate([common, own[0], common, own[1]])
    sig = signatures(ids, np.array([0, 3500, 7000]), 256)
    assert abs((sig[0] == sig[1]).mean() - 3000 / 4000) < 0.12


def rows_of(docs, **settings):
    return {tuple(r) for r in near_duplicates(docs, **settings).drop("group_id").collect()}


def test_edge_cases(spark, docs):
    assert {r for r in rows_of(docs) if r[0] is not None} == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.doc_id is None and not r.kept and r.component_id is None for r in near_duplicates(docs).collect()) == 2
    assert near_duplicates(docs).count() == docs.count()


def test_repeated_and_null_ids(spark):
    """Each row counts with its own text."""
    a, b = "the first text has more than five words in it", "quite another text that is like no other one here"
    rows = [(2, a), (2, b), (1, a), (5, b), (None, b), (None, "no row with an id has this text at all"), (2, a), (7, None), (None, " ")]
    out = near_duplicates(spark.createDataFrame([(i, t, f"k{k}", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, mark string, n long"), keep=("mark",)).collect()
    got = {r.mark: (r.doc_id, r.component_id, r.kept) for r in out}
    assert got == {"k0": (2, 1, False), "k1": (2, 2, True), "k2": (1, 1, True), "k3": (5, 2, False), "k4": (None, 2, False), "k5": (None, None, False), "k6": (2, 1, False), "k7": (7, 7, True), "k8": (None, None, False)}
    group = {r.mark: r.group_id for r in out}
    assert group["k0"] == group["k2"] == group["k6"] != group["k1"] == group["k3"] == group["k4"] != group["k5"] is not None and group["k7"] is None


def test_empty(empty):
    assert near_duplicates(empty).collect() == []


def test_whole_sample_against_brute_force(sample):
    assert rows_of(sample) == brute([(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()])


@pytest.mark.parametrize("rehubs", [0, 1, 3])
def test_rounds_with_other_hubs_change_no_result(sample, monkeypatch, rehubs):
    monkeypatch.setattr(minhash_dedup, "REHUBS", rehubs)
    monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", 500)
    assert rows_of(sample) == brute([(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()])


def test_a_group_of_near_copies_of_near_copies(spark):
    """Members that don't reach the hub still find each other."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        for k in rng.choice(120, int(rng.integers(0, 12)), replace=False):
            t[k] = f"x{i}_{k}"
        rows.append((i, " ".join(t)))
    assert rows_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_block_links_join_what_pairs_join():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(30, int(rng.integers(5, 20)))).astype(np.uint64) for _ in range(25)]
    ids = list(range(25))
    links = block_links(ids, ids, sets, ids, ids, sets, 50)
    parent = list(range(25))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        n = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * n >= 50 * (len(sets[a]) + len(sets[b]) - n)
        parent[max(root(a), root(b))] = min(root(a), root(b))
    for a, b in itertools.combinations(ids, 2):
        n = len(np.intersect1d(sets[a], sets[b]))
        if 100 * n >= 50 * (len(sets[a]) + len(sets[b]) - n):
            assert root(a) == root(b)

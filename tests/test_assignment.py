"""Assignments over tables of edges against the dense solver."""

import numpy as np
import pytest

from kerbside.operators import evaluation, sparse_assignment
from kerbside.operators.assignment import assign
from kerbside.operators.sparse_assignment import auction, most_weight


def optimum(edges):
    rows, columns = sorted({a for a, _, _ in edges}), sorted({b for _, b, _ in edges})
    m = np.zeros((len(rows), len(columns)))
    for a, b, w in edges:
        m[rows.index(a), columns.index(b)] = max(w, m[rows.index(a), columns.index(b)])
    return int(sum(m[i, j] for i, j in assign(-m)))


def check(rows, edges):
    assert len({r.a for r in rows}) == len({r.b for r in rows}) == len(rows)
    assert {(r.a, r.b, r.w) for r in rows} <= set(edges)
    assert sum(r.w for r in rows) == optimum(edges)


def graph(seed, n, m, degree, most):
    rng = np.random.default_rng(seed)
    return list({(int(a), int(b)): (int(a), int(b), int(rng.integers(1, most))) for a, b in zip(rng.integers(0, n, n * degree), rng.integers(0, m, n * degree), strict=True)}.values())


@pytest.mark.parametrize(("seed", "n", "m", "degree", "most"), [(0, 120, 100, 2, 1000), (1, 60, 80, 3, 4), (2, 40, 40, 8, 50)])
def test_most_weight_is_the_optimum(spark, seed, n, m, degree, most):
    """Sparse and dense graphs, many ties; a and b have ids in common."""
    edges = graph(seed, n, m, degree, most)
    check(most_weight(spark.createDataFrame(edges, "a long, b long, w long")).collect(), edges)


def test_the_auction_is_exact(spark):
    """More columns than rows, ties and prices that are fought over."""
    edges = [(0, 10, 3), (0, 11, 2), (1, 10, 3), (1, 12, 1), (2, 10, 2)]
    won = {(r._a, r._b) for r in auction(spark.createDataFrame(edges, "_a long, _b long, w long")).collect()}
    assert len({a for a, _ in won}) == len({b for _, b in won}) == len(won)
    assert sum(w for a, b, w in edges if (a, b) in won) == optimum(edges)


def test_large_components_go_to_the_auction(spark, monkeypatch):
    """With no cells at hand all that is not taken ahead is bid for; ids are texts."""
    called = []
    monkeypatch.setattr(sparse_assignment, "auction", lambda e: called.append(1) or auction(e))
    edges = [("x", "p", 2), ("x", "q", 2), ("y", "p", 2), ("y", "q", 1), ("u", "s", 9)]
    check(most_weight(spark.createDataFrame(edges, "a string, b string, w long"), cells=1).collect(), edges)
    assert called


def test_edge_cases(spark):
    """Nulls, weights of 0 and below, repeated edges, an empty table, single edges."""
    rows = most_weight(spark.createDataFrame([(1, 1, 0), (1, 2, -3), (None, 1, 5), (1, None, 5), (2, 2, 1), (2, 2, 7), (3, 2, 6)], "a long, b long, w long")).collect()
    assert [tuple(r) for r in rows] == [(2, 2, 7)]
    assert most_weight(spark.createDataFrame([], "a long, b long, w long")).collect() == []


def test_a_long_chain_is_no_matrix(spark):
    """Tracks that meet their neighbours: one component, of which no matrix is made."""
    n = 400
    rng = np.random.default_rng(5)
    w = rng.integers(1, 1000, (2, n))
    edges = [(i, i, int(w[0, i])) for i in range(n)] + [(i, i + 1, int(w[1, i])) for i in range(n - 1)]
    rows = most_weight(spark.createDataFrame(edges, "a long, b long, w long")).collect()
    # a path's optimum: take an edge or not, along it
    take = skip = 0
    for k in range(2 * n - 1):
        take, skip = skip + int(w[k % 2, k // 2]), max(skip, take)
    assert sum(r.w for r in rows) == max(take, skip) and len({r.a for r in rows}) == len({r.b for r in rows}) == len(rows)


def test_identity_f1_with_shared_ids(spark):
    rows = [(1, f, 10 if f < 6 else 11) for f in range(10)] + [(2, f, 10 if f < 9 else None) for f in range(10)]
    df = spark.createDataFrame([(t, p) for t, _, p in rows], "track_id long, tracked_id long")
    assert evaluation.identity_f1(df, 20, 19) == pytest.approx(2 * (4 + 9) / 39)

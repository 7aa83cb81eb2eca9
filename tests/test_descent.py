"""Neighbour descent against exact neighbours."""
import numpy as np
import pytest

from helixframe.operators import descent as D
from helixframe.operators import graph as G


def _df(spark, X, parts=3):
    return spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(X)], "vec_id long, embedding array<double>").repartition(parts)


def _exact(X, k, metric="euclidean"):
    diff = X[:, None] - X[None]
    M = np.abs(diff).sum(-1) if metric == "cityblock" else np.sqrt((diff * diff).sum(-1))
    np.fill_diagonal(M, np.inf)
    return np.sort(M, axis=1)[:, :k]


@pytest.mark.parametrize("metric", ["euclidean", "cityblock"])
def test_recall_and_distances(spark, metric):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(700, 12)) + 6 * rng.integers(0, 4, (700, 1))
    rows = D.knn_descent(_df(spark, X), "vec_id", "embedding", 10, metric=metric, leaf_rows=24).collect()
    far = _exact(X, 10, metric)
    assert len(rows) == 7000
    assert {(r["src"], r["rank"]) for r in rows} == {(i, j) for i in range(700) for j in range(1, 11)}
    for r in rows:
        d = X[r["src"]] - X[r["dst"]]
        assert r["src"] != r["dst"]
        assert r["dist"] == pytest.approx(np.abs(d).sum() if metric == "cityblock" else np.sqrt((d * d).sum()), rel=1e-12)
    hits = sum(r["dist"] <= far[r["src"], -1] * (1 + 1e-9) for r in rows)
    assert hits >= 0.95 * 7000


def test_few_rows_equal_exact_graph(spark):
    X = np.random.default_rng(1).normal(size=(9, 3))
    df = _df(spark, X)
    got = {(r["src"], r["rank"], r["dst"]) for r in D.knn_descent(df, "vec_id", "embedding", 30).collect()}
    assert got == {(r["src"], r["rank"], r["dst"]) for r in G.knn_graph(df, "vec_id", "embedding", 30).collect()}
    assert len(got) == 72
    assert D.knn_descent(df.limit(1), "vec_id", "embedding", 5).count() == 0
    assert D.knn_descent(df.limit(0), "vec_id", "embedding", 5).count() == 0


def test_a_third_equal_rows_and_a_hub(spark):
    """Ties: 200 equal vectors, and a centre that is everyone's neighbour."""
    rng = np.random.default_rng(2)
    ring = rng.normal(size=(300, 40))
    X = np.vstack([np.ones((200, 40)) * 3, 5 * ring / np.linalg.norm(ring, axis=1, keepdims=True), np.zeros((1, 40))])
    rows = D.knn_descent(_df(spark, X), "vec_id", "embedding", 8, leaf_rows=32).collect()
    far = _exact(X, 8)
    assert len(rows) == 501 * 8
    assert sum(r["dist"] <= far[r["src"], -1] + 1e-9 for r in rows) >= 0.9 * len(rows)
    assert all(r["dist"] == 0 for r in rows if r["src"] < 200)


def test_partitions_do_not_change_the_graph(spark):
    X = np.random.default_rng(3).normal(size=(300, 6))
    key = lambda g: sorted((r["src"], r["rank"], r["dst"]) for r in g.collect())
    assert key(D.knn_descent(_df(spark, X, 1), "vec_id", "embedding", 6, leaf_rows=20)) == key(D.knn_descent(_df(spark, X, 11), "vec_id", "embedding", 6, leaf_rows=20))


def test_recall_of_partial_graph(spark):
    X = np.random.default_rng(4).normal(size=(210, 4))
    df = _df(spark, X)
    exact = G.knn_graph(df, "vec_id", "embedding", 6)
    full = D.recall(exact, df, "vec_id", "embedding", 6).collect()[0]
    half = D.recall(exact.where("rank <= 3"), df, "vec_id", "embedding", 6).collect()[0]
    assert (full["n_queries"], full["recall"], half["recall"]) == (3, 1.0, 0.5)

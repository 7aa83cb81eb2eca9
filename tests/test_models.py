"""Mahalanobis, k-means, bisecting k-means, power iteration and the linear probe against numpy or known answers."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import cluster as CL
from helixframe.operators import graph as G
from helixframe.operators import pooling as PO


def _df(spark, X, y=None):
    rows = [(i, x.tolist(), int(y[i]) if y is not None else 0) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


@pytest.mark.parametrize("shift", [0.0, 1e6, 1e8])
def test_mahalanobis_equals_numpy(spark, shift):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + shift
    VI = PO.inverse_covariance(_df(spark, X), "embedding")
    want = np.linalg.inv(np.cov((X - X.mean(0)).T))
    assert VI == pytest.approx(want, rel=1e-6 if shift else 1e-10, abs=1e-7)
    p = spark.createDataFrame([(i, X[i].tolist(), X[i + 1].tolist()) for i in range(20)], "idx long, a array<double>, b array<double>")
    got = [r["m"] for r in p.select("idx", PO.mahalanobis("a", "b", VI).alias("m")).orderBy("idx").collect()]
    assert got == pytest.approx([np.sqrt((X[i] - X[i + 1]) @ want @ (X[i] - X[i + 1])) for i in range(20)], rel=1e-5)


def test_singular_covariance(spark):
    X = np.random.default_rng(1).normal(size=(50, 2)) @ np.array([[1.0, 0.0, 1.0], [0.0, 1.0, 1.0]])
    assert PO.inverse_covariance(_df(spark, X), "embedding") == pytest.approx(np.linalg.pinv(np.cov(X.T)), abs=1e-8)


def _blobs(k=4, size=40, seed=2):
    rng = np.random.default_rng(seed)
    y = np.repeat(np.arange(k), size)
    return 10 * np.eye(k)[y] + rng.normal(size=(k * size, k)), y


def _same(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("bisecting", [False, True])
def test_kmeans_finds_the_blobs(spark, bisecting):
    X, y = _blobs()
    pred, facts = CL.kmeans(_df(spark, X, y), "vec_id", "embedding", 4, seed=1, bisecting=bisecting)
    got = [r["cluster"] for r in pred.orderBy("vec_id").collect()]
    assert _same(y, got)
    inertia = sum(((X[y == c] - X[y == c].mean(0)) ** 2).sum() for c in range(4))
    assert facts["cost"] == pytest.approx(inertia, rel=1e-6)
    if not bisecting:
        assert facts["converged"] and 1 <= facts["n_iter"] < 1000


def test_power_iteration_separates_two_rings(spark):
    """Two groups joined by weak edges only."""
    X, y = _blobs(2, 30)
    knn = G.knn_graph(_df(spark, X, y), "vec_id", "embedding", 8)
    bridge = spark.createDataFrame([(0, 45, 1, 3.0)], "src long, dst long, rank int, dist double")
    got = {r["id"]: r["cluster"] for r in CL.power_iteration(knn.unionByName(bridge), 2, sigma=2.0).collect()}
    assert len(got) == 60 and _same(y, [got[i] for i in range(60)])


def test_linear_probe(spark):
    X, y = _blobs(3, 60)
    r = {x["split"]: x for x in CL.linear_probe(_df(spark, X, y), "embedding", "label").collect()}
    assert r["train"]["n"] + r["test"]["n"] == 180 and r["test"]["n"] > 10
    assert r["train"]["accuracy"] == r["test"]["accuracy"] == 1.0
    noise = _df(spark, np.random.default_rng(3).normal(size=X.shape), y)
    assert {x["split"]: x["accuracy"] for x in CL.linear_probe(noise, "embedding", "label").collect()}["test"] < 0.7


def test_pca_axes_equal_numpy(spark):
    X, y = _blobs(3, 50, seed=5)
    P = CL.pca_loadings(_df(spark, X, y), "embedding", 2)
    w, v = np.linalg.eigh(np.cov(X.T))
    for j in range(2):
        assert abs(P[:, j] @ v[:, -1 - j]) == pytest.approx(1.0, abs=1e-8)
    red, k = CL.pca_reduce(_df(spark, X, y), "embedding", 50)
    assert k == 3 and red.agg(F.count("*")).first()[0] == 150

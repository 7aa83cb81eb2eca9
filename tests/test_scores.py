import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import scores as S


def _df(spark, labels, clusters):
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(labels, clusters))]
    return spark.createDataFrame(rows, "vec_id long, label long, cluster long")


def _scores(spark, labels, clusters):
    return S.pair_scores(_df(spark, labels, clusters)).collect()[0].asDict()


def test_identical_partitions_score_one(spark):
    lab = [0, 0, 1, 1, 2, 2, 2]
    r = _scores(spark, lab, lab)
    for k in ("ami", "ari", "fms", "homogeneity", "completeness"):
        assert r[k] == pytest.approx(1.0)


def test_relabelling_invariance(spark):
    lab = [0, 0, 1, 1, 2, 2, 2, 1, 0]
    pred = [1, 1, 0, 2, 2, 0, 2, 1, 0]
    relabelled = [{0: 7, 1: 3, 2: 5}[p] for p in pred]
    a, b = _scores(spark, lab, pred), _scores(spark, lab, relabelled)
    for k in ("ami", "ari", "fms", "homogeneity", "completeness"):
        assert a[k] == pytest.approx(b[k])


def test_homogeneity_completeness_swap(spark):
    lab = [0, 0, 1, 1, 2, 2, 2, 1, 0, 3]
    pred = [1, 1, 0, 0, 0, 2, 2, 1, 0, 0]
    a, b = _scores(spark, lab, pred), _scores(spark, pred, lab)
    assert a["homogeneity"] == pytest.approx(b["completeness"])
    assert a["completeness"] == pytest.approx(b["homogeneity"])


def test_single_cluster_edge(spark):
    r = _scores(spark, [0, 0, 0, 0], [0, 0, 0, 0])
    assert r["ami"] == 1.0 and r["ari"] == 1.0


def test_ami_against_brute_force(spark):
    rng = np.random.default_rng(1)
    lab = rng.integers(0, 4, 60)
    pred = rng.integers(0, 5, 60)
    r = _scores(spark, lab, pred)
    # brute-force expectation over the hypergeometric, straight from the definition
    n = len(lab)
    a = np.bincount(lab)
    b = np.bincount(pred)
    a, b = a[a > 0], b[b > 0]
    lf = lambda x: math.lgamma(x + 1)
    emi = 0.0
    for ai in a:
        for bj in b:
            for nij in range(max(1, ai + bj - n), min(ai, bj) + 1):
                emi += nij / n * math.log(n * nij / (ai * bj)) * math.exp(
                    lf(ai) + lf(bj) + lf(n - ai) + lf(n - bj) - lf(n) - lf(nij) - lf(ai - nij)
                    - lf(bj - nij) - lf(n - ai - bj + nij))
    cont = np.zeros((a.size, b.size))
    for x, y in zip(np.unique(lab, return_inverse=True)[1], np.unique(pred, return_inverse=True)[1]):
        cont[x, y] += 1
    nz = cont > 0
    mi = np.sum(cont[nz] / n * np.log(n * cont[nz] / np.outer(a, b)[nz]))
    ha = -np.sum(a / n * np.log(a / n))
    hb = -np.sum(b / n * np.log(b / n))
    ami = (mi - emi) / ((ha + hb) / 2 - emi)
    assert r["ami"] == pytest.approx(ami, abs=1e-9)
    assert r["homogeneity"] == pytest.approx(mi / ha, abs=1e-12)


def test_calinski_harabasz_matches_numpy(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(40, 3))
    y = rng.integers(0, 3, 40)
    df = spark.createDataFrame([(i, X[i].tolist(), int(y[i])) for i in range(40)],
                               "vec_id long, embedding array<double>, cluster long")
    got = S.geometry_scores(df, [("pred", F.col("cluster"), None)], {"og": "embedding"}).collect()[0]["chs"]
    mean = X.mean(0)
    extra = sum((y == k).sum() * np.sum((X[y == k].mean(0) - mean) ** 2) for k in range(3))
    intra = sum(np.sum((X[y == k] - X[y == k].mean(0)) ** 2) for k in range(3))
    assert got == pytest.approx(extra * (40 - 3) / (intra * 2))


def _exact_expectation(a, b, N):
    """The whole range in rational weights."""
    from fractions import Fraction
    from math import comb, log
    return sum(Fraction(comb(a, k) * comb(N - a, b - k), comb(N, b)) * Fraction(k, N) * Fraction(log(N * k / (a * b))) for k in range(max(1, a + b - N), min(a, b) + 1))


@pytest.mark.parametrize("a,b,N", [(1, 1, 1), (1, 1, 5), (3, 4, 5), (5, 5, 5), (40, 60, 100), (2, 399, 400), (200, 200, 400), (7, 9, 10_000), (1500, 1400, 3000)])
def test_expectation_equals_the_whole_sum(a, b, N):
    want = float(_exact_expectation(a, b, N))
    assert S.hypergeometric_expectation(a, b, N) == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_expectation_of_huge_clusters():
    """Clusters of 10^9 rows: seconds, and the second-order value 1 / (2 N) x (N - a)(N - b) / (...)."""
    import time
    t = time.time()
    N = 4 * 10**9
    a = b = 10**9
    got = S.hypergeometric_expectation(a, b, N)
    # E[k/N log(Nk/ab)] = Var(k) / (2 N mean) + higher orders, with mean ab/N
    var = a * b / N * (1 - a / N) * (1 - b / N) * N / (N - 1)
    assert got == pytest.approx(var / (2 * N * (a * b / N)), rel=1e-4)
    assert time.time() - t < 30

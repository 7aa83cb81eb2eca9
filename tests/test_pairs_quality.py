import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import quality as Q
from helixframe.operators import graph as G
from helixframe.operators.pairs import block_pairs, block_sweep


def _emb(spark, X):
    return spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))],
                                 "vec_id long, embedding array<double>")


def test_block_count_does_not_change_pairs(spark):
    X = np.random.default_rng(0).normal(size=(37, 4))
    df = _emb(spark, X)
    for rows in (3, 8, 1000):
        p = block_pairs(df, "vec_id", [], block_rows=rows)
        got = sorted((min(r["l_id"], r["r_id"]), max(r["l_id"], r["r_id"])) for r in p.collect())
        assert got == [(i, j) for i in range(37) for j in range(i + 1, 37)]


def test_closed_form_moments_equal_pair_form(spark):
    X = np.random.default_rng(3).normal(size=(30, 5))
    X[4] = 0.0  # an all-zero vector stays zero after normalisation
    df = _emb(spark, X)
    m = Q.cosine_moments(df).collect()[0]
    U = X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-12)
    C = U @ U.T
    np.fill_diagonal(C, 0.0)
    assert m["e_costheta"] == pytest.approx(C.mean(), abs=1e-12)
    assert m["v_costheta"] == pytest.approx(C.var(ddof=1), abs=1e-12)


def test_uniformity_and_histogram(spark):
    X = np.random.default_rng(4).normal(size=(25, 3))
    df = _emb(spark, X)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    iu = np.triu_indices(25, 1)
    d2 = np.sum((U[:, None] - U[None]) ** 2, axis=-1)[iu]
    u = Q.uniformity(df).collect()[0]
    assert u["uniform_t2"] == pytest.approx(np.log(np.mean(np.exp(-2 * d2))))
    h = {r["bin"]: r["count"] for r in Q.cosine_histogram(df).collect()}
    C = U @ U.T
    np.fill_diagonal(C, 0.0)
    ref, _ = np.histogram(C.ravel(), bins=20, range=(-1, 1))
    assert [h[b] for b in range(20)] == ref.tolist()


def test_sampled_uniformity_is_unbiased(spark):
    """Estimates of several seeds lie around the exact value as their standard errors say."""
    X = np.random.default_rng(8).normal(size=(150, 5))
    df = _emb(spark, X)
    exact = Q.uniformity(df).collect()[0]["uniform_t2"]
    z = []
    for seed in range(6):
        r = Q.sampled_uniformity(df, draws=4000, strata=16, seed=seed).collect()[0]
        assert r["n_draws"] == 4000 and 0 < r["se"] < 0.1
        z.append((r["uniform"] - exact) / r["se"])
    assert max(map(abs, z)) < 4 and abs(np.mean(z)) < 4 / np.sqrt(6)
    assert len(set(z)) == 6


def test_drawn_pairs(spark):
    d = Q.drawn_pairs(spark, 7, 700, 3).toPandas()
    assert (d["i"] != d["j"]).all() and set(d["i"]) == set(d["j"]) == set(range(7))
    assert all(set(g["i"]) == set(range(h * 7 // 3, (h + 1) * 7 // 3)) for h, g in d.groupby("stratum"))
    assert sorted(d.groupby("stratum").size()) == [233, 233, 234]


def test_sampled_uniformity_of_few_rows(spark):
    one = _emb(spark, np.ones((1, 3)))
    assert tuple(Q.sampled_uniformity(one).collect()[0]) == (0, None, None)
    assert Q.sampled_uniformity(_emb(spark, np.ones((2, 3))), draws=10).collect()[0]["uniform"] == 0.0


def _copied(df):
    """Whether the plan copies rows to their block pairs before a shuffle."""
    return "sequence(" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("directed", [False, True])
def test_sweep_gives_every_block_pair_once(spark, directed):
    import pandas as pd

    def ids(pairs):
        for lb, lt, rb, rt in pairs:
            assert lt["v"].shape == (len(lt["id"]), 2) and (lt["v"][:, 0] == lt["id"]).all()
            a, b = np.meshgrid(lt["id"], rt["id"], indexing="ij")
            keep = a < b if lb == rb and not directed else a != b
            yield pd.DataFrame({"a": a[keep], "b": b[keep]})
    df = spark.range(41).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    got = [tuple(r) for r in block_sweep(df, "id", ["v"], ids, "a long, b long", block_rows=6, directed=directed).collect()]
    want = [(a, b) for a in range(41) for b in range(41) if a != b] if directed else [(a, b) for a in range(41) for b in range(a + 1, 41)]
    assert sorted(got if directed else [(min(p), max(p)) for p in got]) == want


def test_pair_statistics_copy_no_rows(spark):
    df = _emb(spark, np.random.default_rng(4).normal(size=(25, 3)))
    few, one = (Q.pair_statistics(df, block_rows=r).collect()[0] for r in (4, 100))
    assert few["off_hist"] == one["off_hist"] and few["uniform_t2"] == pytest.approx(one["uniform_t2"], abs=1e-12)
    assert not _copied(Q.pair_statistics(df, block_rows=4))
    with pytest.raises(Exception, match="null vectors"):
        Q.pair_statistics(df.union(spark.sql("SELECT 99L, CAST(NULL AS array<double>)"))).collect()


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cityblock"])
def test_neighbours_keep_ties_copies_and_large_norms(spark, metric):
    r = np.random.default_rng(7)
    X = r.integers(0, 3, size=(90, 3)).astype(float)  # many copies and ties
    X[60:] += 1e7  # a matrix product alone cannot tell these apart
    X[80:] *= 1 + 1e-9 * np.arange(10)[:, None]
    X[5, 1] = np.nan
    diff = X[:, None] - X[None]
    D = {"euclidean": lambda: np.sqrt((diff * diff).sum(-1)), "sqeuclidean": lambda: (diff * diff).sum(-1), "cityblock": lambda: np.abs(diff).sum(-1)}[metric]()
    rest = [i for i in range(90) if i != 5]
    want = {i: sorted((j for j in rest if j != i), key=lambda j: (D[i, j], j))[:4] for i in rest}
    g = G.knn_graph(_emb(spark, X), "vec_id", "embedding", 4, metric, block_rows=16)
    got = {}
    for x in sorted(g.collect(), key=lambda x: (x["src"], x["rank"])):
        got.setdefault(x["src"], []).append(x["dst"])
    assert got == want
    assert not _copied(g)


def test_silhouettes_of_many_blocks(spark, monkeypatch):
    """Blocks, flushes and copies leave the silhouettes as they are; one row a cluster and task is handed on, not one a block pair."""
    r = np.random.default_rng(9)
    X = np.vstack([r.normal(size=(50, 4)), np.ones((4, 4)), 1e6 + r.normal(size=(6, 4))])
    c = np.array([i % 3 for i in range(60)])
    df = spark.createDataFrame([(i, X[i].tolist(), int(c[i])) for i in range(60)], "vec_id long, embedding array<double>, c int")
    diff = X[:, None] - X[None]
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    want = {}
    for m, D in (("euclidean", np.sqrt((diff ** 2).sum(-1))), ("l1", np.abs(diff).sum(-1)), ("chebyshev", np.abs(diff).max(-1)), ("arccos", np.sqrt(((U[:, None] - U[None]) ** 2).sum(-1)))):
        a = np.array([D[i, c == c[i]].sum() / ((c == c[i]).sum() - 1) for i in range(60)])
        b = np.array([min(D[i, c == k].mean() for k in range(3) if k != c[i]) for i in range(60)])
        want[m] = ((b - a) / np.maximum(a, b)).mean()
    for rows in (7, 100):
        s = G.silhouettes(df, "vec_id", "embedding", {"c": F.col("c")}, block_rows=rows)
        assert {x["metric"]: x["silhouette"] for x in s.collect()} == pytest.approx(want, abs=1e-9)
        assert not _copied(s)


def test_pair_statistics_over_tiles_are_made_once(spark):
    """Several tiles a block, vectors of any length and a zero vector; the sweep is not part of the plans that read it."""
    X = np.random.default_rng(21).normal(size=(300, 3)) * np.linspace(0.2, 2, 300)[:, None]
    X[7], X[8] = 0.0, X[9]
    U = X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-12)
    iu = np.triu_indices(300, 1)
    raw, unit = (((A[:, None] - A[None]) ** 2).sum(-1)[iu] for A in (X, U))
    cos = (U @ U.T)[iu]
    for rows in (170, 4096):
        st = Q.pair_statistics(_emb(spark, X), block_rows=rows).collect()[0]
        assert (st["uniform_t2"], st["uniform_raw_t2"], st["uniform_t1"]) == pytest.approx(tuple(np.log(np.exp(-t * d).mean()) for t, d in ((2, unit), (2, raw), (1, unit))), abs=1e-9)
        assert st["gamma"] == pytest.approx(np.arccos(cos.min()), abs=1e-9) and st["n"] == 300
        assert st["off_hist"] == np.histogram(cos[np.abs(cos) <= 1], bins=20, range=(-1, 1))[0].tolist()
    h = Q.cosine_histogram(_emb(spark, X))
    plan = h._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Cartesian" not in plan and "crossJoin" not in plan
    assert Q.pair_statistics(_emb(spark, X), stats=("off_hist",)).columns == ["off_hist", "n"]

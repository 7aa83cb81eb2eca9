"""Eigenpairs, embedding and clustering against numpy on small graphs."""
import numpy as np
import pytest

from helixframe.operators import spectral as S


def _ring_of_groups(spark, seed, groups=4, size=30, links=6):
    """Random neighbour edges within groups and a few between neighbouring groups."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(groups * size):
        g = i // size
        for j in rng.choice(size, links, replace=False):
            if g * size + j != i:
                rows.append((i, int(g * size + j), float(rng.random())))
        if i % size < 2:
            rows.append((i, int((g + 1) % groups * size + rng.integers(size)), 1.0))
    return spark.createDataFrame(rows, "src long, dst long, dist double").repartition(5)


def _dense(edges):
    w = edges.toPandas()
    ids = np.unique(w["src"])
    A = np.zeros((len(ids), len(ids)))
    A[np.searchsorted(ids, w["src"]), np.searchsorted(ids, w["dst"])] = w["a"]
    return ids, A


def _matrix(df, names):
    p = df.orderBy("id").toPandas()
    return p[names].to_numpy()


def test_eigenpairs_equal_numpy(spark):
    edges = S.normalised(S.affinity(_ring_of_groups(spark, 0)))
    ids, A = _dense(edges)
    assert np.allclose(A, A.T)
    values, vectors = np.linalg.eigh(A)
    eig = S.top_eigen(edges, 5)
    assert eig.values == pytest.approx(values[::-1][:5], abs=1e-9)
    X = _matrix(eig.vectors, [f"x{j}" for j in range(5)])
    assert X.T @ X == pytest.approx(np.eye(5), abs=1e-7)
    assert np.linalg.norm(A @ X - X * eig.values, axis=0).max() <= 2e-6
    # the first four belong to the groups and stand apart from the rest: same subspace as numpy's
    P = vectors[:, ::-1][:, :4]
    assert X[:, :4] @ X[:, :4].T == pytest.approx(P @ P.T, abs=1e-5)


def test_parts_and_small_graphs(spark):
    two = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (7, 8, 1.0), (8, 9, 1.0), (9, 7, 1.0)], "src long, dst long, dist double")
    eig = S.top_eigen(S.normalised(S.affinity(two)), 9)  # more than there are nodes
    _, A = _dense(S.normalised(S.affinity(two)))
    assert eig.values == pytest.approx(np.linalg.eigvalsh(A)[::-1], abs=1e-9)
    assert eig.values[:2] == pytest.approx([1, 1])
    assert sorted(tuple(r) for r in S.spectral_clustering(two, 2).collect()) == [(1, 0), (2, 0), (7, 1), (8, 1), (9, 1)]
    with pytest.raises(ValueError, match="without edges"):
        S.top_eigen(S.normalised(S.affinity(two.limit(0))), 2)


def test_clusters_are_the_groups(spark):
    got = {r["id"]: r["cluster"] for r in S.spectral_clustering(_ring_of_groups(spark, 3, groups=3), 3).collect()}
    assert got == {i: i // 30 for i in range(90)}


def test_embedding_is_the_scaled_eigenvectors(spark):
    knn = _ring_of_groups(spark, 5, groups=3, size=20)
    y, _ = S.spectral_embedding(knn, 2)
    w = S.affinity(knn)
    ids, A = _dense(S.normalised(w))
    d = {r["src"]: r["d"] for r in w.groupBy("src").agg({"w": "sum"}).withColumnRenamed("sum(w)", "d").collect()}
    _, vectors = np.linalg.eigh(A)
    want = vectors[:, ::-1][:, 1:3] / np.sqrt([[d[i]] for i in ids])
    got = np.array([r["reduced"] for r in y.orderBy("id").collect()])
    # as subspaces scaled by degree: each coordinate up to its sign where the values differ
    for j in range(2):
        sign = np.sign(want[np.abs(want[:, j]).argmax(), j])
        assert got[np.abs(got[:, j]).argmax(), j] > 0
        assert got[:, j] == pytest.approx(want[:, j] * sign, abs=1e-4)


def test_many_blocks_give_the_same_and_edges_stay_packed(spark):
    """A product handles one packed row for each pair of blocks, not one for each edge."""
    edges = S.normalised(S.affinity(_ring_of_groups(spark, 0))).localCheckpoint()
    ids, A = _dense(edges)
    eig = S.top_eigen(edges, 4, block_rows=13)
    assert eig.values == pytest.approx(np.linalg.eigvalsh(A)[::-1][:4], abs=1e-9)
    X = _matrix(eig.vectors, [f"x{j}" for j in range(4)])
    assert np.linalg.norm(A @ X - X * eig.values, axis=0).max() <= 2e-6
    nodes = spark.createDataFrame([(int(i), int(i % 3), int(i // 3)) for i in ids], "id long, b int, pos int")
    packed = S._packed(edges, nodes).collect()
    assert len(packed) == 9 and sum(len(r["val"]) for r in packed) == 8 * edges.count()


def test_near_nodes_share_blocks(spark):
    """Parts of the graph keep to themselves: nodes of a part get one mark, so blocks in its order share edges within the part only."""
    rows = [(p * 40 + i, p * 40 + (i + j) % 40, 1.0) for p in range(3) for i in range(40) for j in (1, 2, 5, 11)]
    edges = S.normalised(S.affinity(spark.createDataFrame(rows, "src long, dst long, dist double")))
    marks = {r["id"]: r["l"] for r in S._near(edges, edges.selectExpr("src AS id").distinct()).collect()}
    assert len(marks) == 120 and [len({marks[p * 40 + i] for i in range(40)}) for p in range(3)] == [1, 1, 1] and len(set(marks.values())) == 3
    eig = S.top_eigen(edges, 3, block_rows=40)
    assert eig.values == pytest.approx([1, 1, 1], abs=1e-9)

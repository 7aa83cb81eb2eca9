import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators.ward import cut_tree, ward, ward_merges
from helixframe.operators.indexing import dense_index, running_agg


def greedy_ward(X, k):
    members = {i: [i] for i in range(len(X))}
    cent = {i: X[i].copy() for i in range(len(X))}
    size = {i: 1 for i in range(len(X))}
    while len(members) > k:
        best = None
        ids = sorted(members)
        for ai, a in enumerate(ids):
            for b in ids[ai + 1:]:
                h = size[a] * size[b] / (size[a] + size[b]) * np.sum((cent[a] - cent[b]) ** 2)
                if best is None or h < best[0]:
                    best = (h, a, b)
        _, a, b = best
        cent[a] = (cent[a] * size[a] + cent[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        members[a] += members.pop(b)
        del cent[b], size[b]
    lab = np.zeros(len(X), int)
    for c, (_, mem) in enumerate(sorted(members.items())):
        lab[mem] = c
    return lab


def same_partition(a, b):
    m = {}
    return all(m.setdefault(x, y) == y for x, y in zip(a, b)) and len(set(a)) == len(set(b))


def _frame(spark, X):
    return spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("case", ["plain", "shifted", "ties"])
def test_ward_equals_greedy(spark, case):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(loc=c, size=(8, 4)) for c in range(4)])
    if case == "shifted":
        X = X + 1e7
    if case == "ties":  # duplicates: every height below the cut is 0 or apart from the others
        X = np.repeat(X[::4], 3, axis=0)
    df = _frame(spark, X)
    # rounds as jobs over several blocks, down to two clusters; one task finishes
    for options in ({"block_rows": 8, "finish_rows": 2, "n_pivots": 3}, {}):
        merges = ward_merges(df, "vec_id", "embedding", **options).persist()
        assert merges.count() == len(X) - 1
        for k in (2, 4):
            got = [r["cluster"] for r in cut_tree(df, "vec_id", merges, k).orderBy("vec_id").collect()]
            assert same_partition(list(greedy_ward(X, k)), got)


def test_pruning_keeps_the_merges(spark):
    """Groups apart in a turned direction: the same merge table as without pruning, for a fraction of its pairs."""
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    X = (rng.normal(size=(240, 10)) * 0.3 + 8 * np.eye(10)[rng.integers(0, 6, 240)]) @ turn
    df = _frame(spark, X)
    key = lambda m: sorted((r["a"], r["b"], round(r["h"], 9), r["round"]) for r in m.collect())
    rep, whole = {}, {}
    pruned = key(ward_merges(df, "vec_id", "embedding", finish_rows=100, n_pivots=12, report=rep))
    everyone = key(ward_merges(df, "vec_id", "embedding", finish_rows=100, n_pivots=1, report=whole))
    assert len(pruned) == 239 and pruned == everyone == key(ward_merges(df, "vec_id", "embedding"))
    assert rep["pairs"] < 0.5 * whole["pairs"]


@pytest.mark.parametrize("case", ["plain", "shifted", "copies", "wide", "not finite"])
def test_screened_heights_have_the_same_least(case):
    """The least of each row and column, with its ties, is that of all heights; few pairs are computed where rows differ."""
    from helixframe.operators.ward import _candidate_heights, _heights
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(60, 16)), rng.normal(size=(70, 16))
    if case == "shifted":
        a, b = a + 1e8, b + 1e8
    if case == "copies":
        a, b = np.repeat(a[:6], 10, axis=0), np.repeat(np.vstack([a[:4], b[:3]]), 10, axis=0)
    if case == "wide":
        a, b = a * 10.0 ** rng.integers(-9, 9, (60, 1)), b * 10.0 ** rng.integers(-9, 9, (70, 1))
    if case == "not finite":
        a[3, 2], b[5, 1], b[6, 0] = np.nan, np.inf, 1e200
    na, nb = rng.integers(1, 50, 60).astype(float), rng.integers(1, 50, 70).astype(float)
    same = np.arange(60)[:, None] == np.arange(70)[None, :] + 5
    with np.errstate(all="ignore"):
        whole = np.where(same, np.inf, _heights(na, a, nb, b))
    got = _candidate_heights(na, a, nb, b, same)
    for axis in (0, 1):
        assert np.array_equal(whole.min(axis), got.min(axis), equal_nan=True) and np.array_equal(whole.argmin(axis), got.argmin(axis))
    if case in ("plain", "shifted"):
        assert np.isfinite(got).sum() < 0.1 * whole.size


def test_ward_of_few_rows(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert ward_merges(df, "vec_id", "embedding").count() == 0 and ward_merges(df.limit(0), "vec_id", "embedding").count() == 0
    assert [tuple(r) for r in ward(df, "vec_id", "embedding", 1).collect()] == [(5, 0)]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_dense_index_partition_invariant_with_hot_group(spark, parts):
    # group 0 holds a third of the rows
    rows = [(0 if i % 3 == 0 else i % 7, i, float((i * 37) % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, t long, v double").repartition(parts)
    got = {(r["g"], r["t"]): r["idx"] for r in dense_index(df, ["t"], ["g"], n_parts=5).collect()}
    exp = {}
    for g in set(r[0] for r in rows):
        for k, t in enumerate(sorted(r[1] for r in rows if r[0] == g)):
            exp[(g, t)] = k
    assert got == exp
    run = running_agg(df, "v", ["t"], ["g"], op="max", name="m", exclusive=True, n_parts=5).collect()
    for r in run:
        prev = [x[2] for x in rows if x[0] == r["g"] and x[1] < r["t"]]
        assert r["m"] == (max(prev) if prev else None)


@pytest.mark.parametrize("case", ["plain", "shifted", "copies", "wide", "not finite"])
def test_nearest_targets_are_those_of_all_heights(case):
    """Best target of every asker, ties to the first, and the pairs no higher than what a target knows; rows at a time and in place."""
    from helixframe.operators.ward import _heights, _nearest
    rng = np.random.default_rng(12)
    t = rng.normal(size=(80, 16))
    if case == "shifted":
        t = t + 1e8
    if case == "copies":
        t = np.repeat(t[:8], 10, axis=0)
    if case == "wide":
        t = t * 10.0 ** rng.integers(-9, 9, (80, 1))
    if case == "not finite":
        t[3, 2], t[5, 1] = np.nan, 1e200
    n = rng.integers(1, 50, 80).astype(float)
    q = np.arange(0, 80, 3)
    with np.errstate(all="ignore"):
        whole = _heights(n[q], t[q], n, t)
    whole[np.arange(len(q)), q] = np.inf
    whole = np.where(np.isfinite(whole), whole, np.inf)
    known = np.where(np.arange(80) % 3 == 1, np.median(whole[np.isfinite(whole)]), -np.inf)
    best, place, (h, at, by) = _nearest(n[q], t[q], q, n, t, known)
    assert np.array_equal(best, whole.min(1))
    ok = np.isfinite(best)
    assert np.array_equal(place[ok], whole.argmin(1)[ok])
    assert {(j, i): x for x, j, i in zip(h, at, by)} == {(j, i): whole[i, j] for i, j in zip(*np.nonzero(whole <= known[None, :]))}


def test_the_last_merges_hold_no_matrix(spark):
    """The one-task part keeps less than half a matrix of its clusters, and gives the merges of the rounds that run as jobs."""
    import tracemalloc
    from helixframe.operators.ward import _merged_in_task
    rng = np.random.default_rng(13)
    X = rng.normal(size=(3000, 8)) + 6 * np.eye(8)[rng.integers(0, 8, 3000)]
    tracemalloc.start()
    rows = _merged_in_task(np.arange(3000), np.ones(3000), X, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 2999 and peak < 3000 * 3000 * 8 / 2
    few = X[:300]
    jobs = ward_merges(_frame(spark, few), "vec_id", "embedding", block_rows=40, finish_rows=150, n_pivots=6).collect()
    assert sorted((a, b, round(h, 9), r) for a, b, h, r in jobs) == sorted((a, b, round(h, 9), r) for a, b, h, r in _merged_in_task(np.arange(300), np.ones(300), few, 0))

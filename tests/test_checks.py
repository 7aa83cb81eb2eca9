"""Checks that must fail a job, and graph edges that must all arrive."""
import numpy as np
import pytest

from helixframe.operators.cluster import undirected
from helixframe.operators.contrastive import logits
from helixframe.operators.encode import Lookup
from helixframe.operators.scores import expected_mutual_information
from helixframe.operators.shape import fuse_modalities, resolve_views

SCHEMA = "vec_id long, embedding array<double>, label long"


def test_fusion_needs_equal_labels_and_samples(spark):
    a = spark.createDataFrame([(1, [1.0], 5), (2, [2.0], None)], SCHEMA)
    same = spark.createDataFrame([(1, [3.0], 5), (2, [4.0], None)], SCHEMA)
    assert sorted(tuple(r) for r in fuse_modalities(a, same).collect()) == [(1, [1.0, 3.0], 5), (2, [2.0, 4.0], None)]
    other = spark.createDataFrame([(1, [3.0], 9), (2, [4.0], None)], SCHEMA)
    with pytest.raises(Exception, match="disagree on a label"):
        fuse_modalities(a, other).collect()
    with pytest.raises(Exception, match="differ in their samples|disagree on a label or a sample"):
        fuse_modalities(a, same.where("vec_id = 1")).collect()


def test_undirected_keeps_every_edge(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), float(abs(a - b))) for a, b in rng.integers(0, 40, (300, 2)) if a != b]
    got = {(r["src"], r["dst"]) for r in undirected(spark.createDataFrame(rows, "src long, dst long, dist double")).collect()}
    assert got == {(min(a, b), max(a, b)) for a, b, _ in rows}


def test_view_roles_need_one_to_three_columns(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", "d")], "k long, w string, x string, y string, z string")
    with pytest.raises(ValueError):
        resolve_views(df, keys=["k"])
    assert resolve_views(df.select("k", "w"), keys=["k"]).collect()[0].asDict() == {"k": 1, "sent0": "a", "sent1": "a"}


def test_lookup_follows_the_vocabulary(spark):
    vocab = spark.range(6000).selectExpr("concat('t', id) AS token", "cast(id AS int) AS id")
    df = spark.createDataFrame([(["t5999", "zz", None],), ([],), (None,)], "t array<string>")
    from pyspark.sql import functions as F
    assert [r[0] for r in df.select(Lookup(vocab)(F.col("t"))).collect()] == [[5999, 1, 1], [], None]


def test_expectation_sums_the_whole_range_of_large_clusters(spark):
    from math import exp, lgamma, log
    cont = spark.createDataFrame([(0, 0, 3000), (0, 1, 1000), (1, 0, 500), (1, 1, 2500)], "label long, cluster long, n long")
    n, want = 7000, 0.0
    for a in (4000, 3000):
        for b in (3500, 3500):
            for k in range(max(1, a + b - n), min(a, b) + 1):
                lp = sum(lgamma(x + 1) for x in (a, b, n - a, n - b)) - sum(lgamma(x + 1) for x in (n, k, a - k, b - k, n - a - b + k))
                want += k / n * log(n * k / (a * b)) * exp(lp)
    assert expected_mutual_information(cont).collect()[0]["emi"] == pytest.approx(want, rel=1e-9)


def test_only_wanted_blocks_are_planned(spark):
    b = spark.createDataFrame([(0, i, [1.0, float(i)], [float(i), 2.0]) for i in range(3)], "batch long, pos int, z1 array<double>, z2 array<double>")
    lg = logits(b, blocks=("A",))
    assert {r["block"] for r in lg.select("block").distinct().collect()} == {"A"}
    assert "zmix" not in lg._jdf.queryExecution().optimizedPlan().toString()

"""Operators on the dense index or the running scan give the same rows for any partitioning, also without exchange reuse."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import ranking as RA
from helixframe.operators import runs as RU
from helixframe.operators.cluster import pca_loadings
from helixframe.operators.hooks import collate_batches
from helixframe.operators.shape import batch_plan, seeded_head


@pytest.fixture(params=[True, False], ids=["reuse", "no-reuse"])
def session(spark, request):
    spark.conf.set("spark.sql.exchange.reuse", str(request.param).lower())
    yield spark
    spark.conf.unset("spark.sql.exchange.reuse")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def log(spark, parts):
    rows = [(0 if i % 3 == 0 else i % 5, i // 5, float((i * 37) % 23)) for i in range(300)]
    return spark.createDataFrame(rows, "trial long, step long, value double").groupBy("trial", "step").agg(F.max("value").alias("value")).repartition(parts)


def operators(spark, parts):
    x = log(spark, parts)
    trials = spark.createDataFrame([(i, "COMPLETE" if i < 3 else "RUNNING", 1.0) for i in range(5)], "trial long, state string, value double")
    ids = spark.range(250).select((F.col("id") * 7 % 251).alias("doc_id")).repartition(parts)
    scored = ids.select("doc_id", (F.col("doc_id") % 13 / 13.0).alias("score"), (F.col("doc_id") % 3 == 0).cast("int").alias("label"))
    return {"plan": batch_plan(ids, ["doc_id"], 16, 2), "head": seeded_head(ids, "doc_id", 3, 0.3), "pruned": RU.median_pruning(x, trials, n_startup=2),
            "precision": RA.average_precision(scored).select("n", F.round("auprc", 9)),
            "collated": collate_batches(ids, ["doc_id"], 32, lambda p: p.agg({"doc_id": "sum"}).to_frame().T.rename(columns={"doc_id": "s"}), "s bigint")}


def test_partition_invariance(session):
    want = {k: rows_of(v) for k, v in operators(session, 1).items()}
    for parts in (3, 17):
        assert {k: rows_of(v) for k, v in operators(session, parts).items()} == want


def test_median_by_rank(spark):
    x = log(spark, 4)
    trials = spark.createDataFrame([(i, "COMPLETE" if i < 4 else "RUNNING", 1.0) for i in range(5)], "trial long, state string, value double")
    got = {r["step"]: r["median"] for r in RU.median_pruning(x, trials).collect()}
    for step, median in got.items():
        values = [r["value"] for r in x.where(f"step = {step} and trial < 4").collect()]
        assert median == (float(np.median(values)) if values else None)


def test_pca_axes_are_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(200, 5)) * [3, 2, 1, 0.5, 0.1]
    P = pca_loadings(spark.createDataFrame([(x.tolist(),) for x in X], "v array<double>"), "v", 3)
    vals, vecs = np.linalg.eigh(np.cov(X.T))
    for k in range(3):
        assert abs(abs(P[:, k] @ vecs[:, -1 - k]) - 1) < 1e-8

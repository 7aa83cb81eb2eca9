"""Dimension reduction and clustering.

* K2  PCA from ``pyspark.ml`` (the d x k loadings are the only driver-side
      object), with a sign convention so reruns replay exactly.
* K4  Ward agglomerative clustering lives in ``ward.py``.
* K16/K17 KMeans, BisectingKMeans and power iteration clustering from
      ``pyspark.ml``.  K18 a logistic-regression linear probe.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions.hashing import uniform
from helixframe.operators.ward import cut_tree, ward, ward_merges  # noqa: F401  (K4 under its family's name)


def _vec(df: DataFrame, vec: str, out: str = "_v") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out, array_to_vector(F.col(vec)))


def pca_loadings(df: DataFrame, vec: str, k: int) -> np.ndarray:
    """d x k principal axes; each column's largest-magnitude entry made positive."""
    from pyspark.ml.feature import PCA
    m = PCA(k=k, inputCol="_v", outputCol="_p").fit(_vec(df.select(vec), vec))
    pc = m.pc.toArray()
    idx = np.argmax(np.abs(pc), axis=0)
    signs = np.sign(pc[idx, np.arange(pc.shape[1])])
    signs[signs == 0] = 1.0
    return pc * signs


def project(df: DataFrame, vec: str, P: np.ndarray, out: str = "reduced") -> DataFrame:
    """Row-wise x @ P in numpy inside the tasks (P is d x k, broadcast)."""
    bc = df.sparkSession.sparkContext.broadcast(P)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        Pm = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.vstack(pdf[vec].to_numpy())
            yield pdf.assign(**{out: list(X @ Pm)})
    return df.mapInPandas(run, schema)


def pca_reduce(df: DataFrame, vec: str, k: int = 50, out: str = "reduced") -> tuple[DataFrame, int]:
    """K2: reduce to min(k, d) dimensions (no centering, as Spark's PCA transform)."""
    d = df.select(F.size(vec)).first()[0]
    kk = min(k, d)
    return project(df, vec, pca_loadings(df, vec, kk), out), kk


def kmeans(df: DataFrame, id_col: str, vec: str, k: int, seed: int = 0, max_iter: int = 1000,
           bisecting: bool = False) -> tuple[DataFrame, dict]:
    """KMeans or BisectingKMeans; returns (id, cluster) and the run facts."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    algo = (BisectingKMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="cluster")
            if bisecting else
            KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="cluster"))
    v = _vec(df.select(id_col, vec), vec)
    m = algo.fit(v)
    facts = {"n_iter": int(getattr(m.summary, "numIter", -1)),
             "converged": bool(getattr(m.summary, "numIter", max_iter) < max_iter),
             "cost": float(m.summary.trainingCost)}
    return m.transform(v).select(id_col, "cluster"), facts


def undirected(edges: DataFrame) -> DataFrame:
    """(src < dst, dist): one row for each pair that an edge joins in either direction."""
    return (edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "dist")
            .groupBy("src", "dst").agg(F.min("dist").alias("dist")))


def power_iteration(edges: DataFrame, k: int, sigma: float = 1.0) -> DataFrame:
    """K17 spectral-style clusterer on the kNN graph (K3): weights exp(-d^2 / sigma^2)."""
    from pyspark.ml.clustering import PowerIterationClustering
    u = undirected(edges)
    w = u.select("src", "dst", F.exp(-(F.col("dist") * F.col("dist")) / F.lit(sigma * sigma)).alias("weight"))
    pic = PowerIterationClustering(k=k, maxIter=30, weightCol="weight", srcCol="src", dstCol="dst")
    return pic.assignClusters(w)


def linear_probe(df: DataFrame, vec: str, label: str, seed: int = 0, train_frac: float = 0.8, id_col: str = "vec_id") -> DataFrame:
    """Logistic regression on a hash split; accuracy per split."""
    from pyspark.ml.classification import LogisticRegression
    v = _vec(df, vec).withColumn("_split", F.when(uniform(F.lit(seed), F.lit("split"), F.col(id_col))
                                                  < train_frac, "train").otherwise("test"))
    v = v.withColumn("_y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=100).fit(v.where("_split = 'train'"))
    pred = model.transform(v)
    return pred.groupBy(F.col("_split").alias("split")).agg(
        F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))

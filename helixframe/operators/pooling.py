"""Pooling, projection and pre-normalisation of vectors.

Token-level pooling works on the long table ``(seq_id, layer, pos, mask, h)``:
``posexplode`` to (dim, x), a grouped masked sum, and an ordered re-collection
of the d dimensions (a group of exactly d rows).  Dense algebra with a small
parameter matrix (projection head, Gram matrix) runs as numpy inside
``mapInPandas`` tasks; the parameter matrix is d x d, never data-sized.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import vectors as V
from helixframe.functions.hashing import hash_u32
from helixframe.operators.common import zip_rows

POOLERS = ("cls", "cls_before_pooler", "avg", "avg_first_last", "avg_top2")


def collect_dims(long: DataFrame, keys: list[str], dim: str = "dim", val: str = "v",
                 out: str = "pooled") -> DataFrame:
    """(keys, dim, v) -> (keys, array ordered by dim)."""
    return (long.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(dim).alias("d"), F.col(val).alias("v"))))
                 .alias("_a"))
            .select(*keys, F.col("_a.v").alias(out)))


def pool(hidden: DataFrame, pooler: str, n_layers: int) -> DataFrame:
    """E1-E4 on (seq_id, layer, pos, mask, h): one pooled vector per seq_id.

    cls / cls_before_pooler: position 0 of the last layer.  avg: masked mean of
    the last layer (0/0 gives NaN).  avg_first_last: masked mean of
    (layer[1] + layer[-1]) / 2.  avg_top2: of (layer[-2] + layer[-1]) / 2.
    """
    last = n_layers - 1
    if pooler in ("cls", "cls_before_pooler"):
        return hidden.where((F.col("layer") == last) & (F.col("pos") == 0)).select(
            "seq_id", F.col("h").alias("pooled"))
    layers = {"avg": [last], "avg_first_last": [1, last], "avg_top2": [last - 1, last]}[pooler]
    x = hidden.where(F.col("layer").isin(layers)).select(
        "seq_id", "mask", F.posexplode("h").alias("dim", "x"))
    # Each position appears once per chosen layer, so the ratio of sums is the
    # masked mean of the layer average.
    s = x.groupBy("seq_id", "dim").agg(
        F.sum(F.col("mask") * F.col("x")).alias("num"), F.sum("mask").cast("double").alias("den"))
    v = F.when(F.col("den") == 0, F.lit(float("nan"))).otherwise(F.col("num") / F.col("den"))
    return collect_dims(s.select("seq_id", "dim", v.alias("v")), ["seq_id"])


def token_pool(hidden: DataFrame, how: str, layer: int) -> DataFrame:
    """Unmasked mean or max over positions of one layer."""
    x = hidden.where(F.col("layer") == layer).select("seq_id", F.posexplode("h").alias("dim", "x"))
    agg = F.avg("x") if how == "mean" else F.max("x")
    return collect_dims(x.groupBy("seq_id", "dim").agg(agg.alias("v")), ["seq_id"])


def md5_weights(d: int, seed: int = 3, scale: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Deterministic d x d weights and bias from md5 (same rule as the SQL twin)."""
    import hashlib

    def u(*parts):
        h = hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()[:8]
        return int(h, 16) / 4294967296.0
    W = np.array([[(u(seed, "w", o, i) - 0.5) * scale for i in range(d)] for o in range(d)])
    b = np.array([(u(seed, "b", o) - 0.5) * scale for o in range(d)])
    return W, b


def mlp_head(df: DataFrame, vec: str, W: np.ndarray, b: np.ndarray, out: str = "projected") -> DataFrame:
    """E5: tanh(W x + b) per row; W is d x d (a model parameter, not data-sized)."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((W, b))
    fields = [f for f in df.schema.fields]
    schema = T.StructType(fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        Wm, bv = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.vstack(pdf[vec].to_numpy())
            Y = np.tanh(X @ Wm.T + bv)
            yield pdf.assign(**{out: list(Y)})
    return df.mapInPandas(run, schema)


def column_stats(df: DataFrame, vec: str) -> DataFrame:
    """Per-dimension mean and population std as two arrays (one row)."""
    x = df.select(F.posexplode(vec).alias("dim", "x"))
    s = x.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    a = s.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "sd"))).alias("_a"))
    return a.select(F.col("_a.m").alias("mean"), F.col("_a.sd").alias("std"))


def prenormalise(df: DataFrame, vec: str, method: str) -> DataFrame:
    """None | l2 | l2_corrected | zscore | avg_zscore (population std).

    Column statistics are one d-sized aggregate, projected back as a scalar
    subquery (size d, independent of n).
    """
    if method == "none":
        return df
    if method == "l2":
        return df.withColumn(vec, V.l2_normalize(vec))
    if method == "l2_corrected":
        d = F.size(vec).cast("double")
        return df.withColumn(vec, F.transform(V.l2_normalize(vec), lambda v: v * F.sqrt(d)))
    st = column_stats(df, vec)
    s = st.select(F.struct("mean", "std").alias("s")).scalar()
    j = df.withColumn("_mean", s.getField("mean")).withColumn("_std", s.getField("std"))
    if method == "zscore":
        z = F.zip_with(F.zip_with(vec, "_mean", lambda x, m: x - m), "_std",
                       lambda c, sd: F.when(sd == 0, F.lit(float("nan"))).otherwise(c / sd))
    elif method == "avg_zscore":
        msd = F.aggregate("_std", F.lit(0.0), lambda a, v: a + v) / F.size("_std")
        z = F.transform(F.zip_with(vec, "_mean", lambda x, m: x - m),
                        lambda c: F.when(msd == 0, F.lit(float("nan"))).otherwise(c / msd))
    else:
        raise ValueError(method)
    return j.withColumn(vec, z).drop("_mean", "_std")


def dim_correct(vec) -> F.Column:
    """X / sqrt(d) for Euclidean-type metrics."""
    c = F.col(vec) if isinstance(vec, str) else vec
    return F.transform(c, lambda v: v / F.sqrt(F.size(c).cast("double")))


def inverse_covariance(df: DataFrame, vec: str) -> np.ndarray:
    """d x d inverse covariance for Mahalanobis: the Gram matrix of the rows less their mean, summed on the executors (a common shift
    of the data costs no digits), inverted on the driver (size d^2, not n).  A singular covariance gets its pseudo-inverse."""
    from helixframe.operators.quality import gram
    mu = column_stats(df, vec).select("mean").collect()[0]["mean"]
    centred = df.select(F.transform(vec, lambda v, i: v - F.element_at(F.array(*[F.lit(float(m)) for m in mu]), i + 1)).alias("u"))
    d, n = len(mu), df.count()
    G = np.zeros((d, d))
    for r in gram(centred).collect():
        G[r["a"], r["b"]] = r["g"]
    return np.linalg.pinv(G / (n - 1))


def mahalanobis(x, y, inverse: np.ndarray) -> F.Column:
    """sqrt((x - y)' VI (x - y)) of two vector columns."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in inverse])
    diff = V.sub(x, y)
    q = F.aggregate(F.zip_with(rows, diff, lambda r, di: di * V.dot(r, diff)), F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(F.greatest(q, F.lit(0.0)))


def hashed_embedding(tokens_df: DataFrame, key: str, tokens: str, dim: int = 64,
                     seed: int = 5) -> DataFrame:
    """E14 built-in scorer: signed feature hashing of tokens, L2-normalised.

    Token t adds sign(t) to dimension h(t) mod dim, with h and sign from md5.
    Pure SQL: explode and one grouped aggregate with a sum for each dimension, so a
    row's tokens are summed before the shuffle; zeros for empty dimensions and rows without tokens.
    """
    x = tokens_df.select(key, F.explode(tokens).alias("t"))
    h = hash_u32(F.lit(seed), F.col("t"))
    x = x.select(key, F.pmod(h, F.lit(dim)).cast("int").alias("dim"),
                 F.when((F.floor(h / dim) % 2) == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("s"))
    m = x.groupBy(key).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("dim") == i, F.col("s"))), F.lit(0.0)) for i in range(dim)]).alias("_v"))
    dense = F.coalesce("_v", F.array_repeat(F.lit(0.0), dim))
    allk = tokens_df.select(key).join(m, key, "left")
    return allk.select(key, V.l2_normalize(dense).alias("embedding"))


def embed_with(df: DataFrame, scorer, id_col: str, dim: int, cols: list[str]) -> DataFrame:
    """U1/E14 hook: ``scorer(pandas.DataFrame) -> 2-d array (rows x dim)``.

    The scorer sees Arrow batches of ``cols`` (for example input_ids and
    attention_mask) and returns one vector per row, so any model can be
    plugged in; Spark partitions the rows and keeps the labels and order.
    """
    schema = T.StructType([df.schema[id_col], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            Y = np.asarray(scorer(pdf[cols]), dtype="float64")
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "embedding": list(Y.reshape(len(pdf), dim))})
    return df.select(id_col, *cols).mapInPandas(run, schema)


def id_stats_scorer(pdf: pd.DataFrame) -> np.ndarray:
    """A small scorer for the hook, over whole batches: count, mean, least and largest id of the real positions."""
    ids = np.stack(pdf["input_ids"].to_numpy()).astype(float)
    m = np.stack(pdf["attention_mask"].to_numpy()).astype(bool)
    n = m.sum(1)
    some = n > 0
    mean = np.divide(np.where(m, ids, 0).sum(1), n, out=np.zeros(len(n)), where=some)
    low, high = np.where(m, ids, np.inf).min(1), np.where(m, ids, -np.inf).max(1)
    return np.column_stack([n, mean, np.where(some, low, 0.0), np.where(some, high, 0.0)])

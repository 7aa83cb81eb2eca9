"""Embedding-quality aggregates: alignment, uniformity, cosine statistics.

Closed forms are used wherever they exist (cosine mean and variance need no
pairs: they follow from the sum vector and the d x d Gram matrix); the
pairwise statistics (uniformity, widest angle, histogram) share one blocked
all-pairs pass.
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
from helixframe.operators.indexing import dense_index
from helixframe.operators.pairs import block_sweep
from helixframe.session import cut_lineage

HIST_BINS = 20


def alignment(pairs: DataFrame, x: str = "z1", y: str = "z2", alpha: float = 2.0) -> DataFrame:
    """Q1: mean ||x^ - y^||^alpha over rows (x^ = L2-normalised)."""
    d = V.norm(V.sub(V.l2_normalize(x), V.l2_normalize(y)))
    return pairs.agg(F.avg(F.pow(d, F.lit(alpha))).alias("align"))


def normalized(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vec).alias("x"),
                     V.l2_normalize(vec).alias("u"))


def _gram_partition():
    def fn(batches):
        acc = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.vstack(pdf["u"].to_numpy())
            g = X.T @ X
            acc = g if acc is None else acc + g
        if acc is None:
            return
        d = acc.shape[0]
        a, b = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
        yield pd.DataFrame({"a": a.ravel().astype("int32"), "b": b.ravel().astype("int32"),
                            "g": acc.ravel()})
    return fn


def gram(u: DataFrame, col: str = "u") -> DataFrame:
    """(a, b, g) = sum_i u_ia u_ib: per-partition numpy partial sums, then one d^2 aggregate."""
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
                           T.StructField("g", T.DoubleType())])
    part = u.select(F.col(col).alias("u")).mapInPandas(_gram_partition(), schema)
    return part.groupBy("a", "b").agg(F.sum("g").alias("g"))


def cosine_moments(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Q3 + Q4 in closed form over the N x N cosine matrix with a zero diagonal.

    sum_{i!=j} c_ij = |sum u|^2 - sum |u|^2 ;
    sum_{i!=j} c_ij^2 = ||U^T U||_F^2 - sum |u|^4.
    """
    u = normalized(df, id_col, vec)
    per_dim = u.select(F.posexplode("u").alias("dim", "x")).groupBy("dim").agg(F.sum("x").alias("s"))
    s1 = per_dim.agg(F.sum(F.col("s") * F.col("s")).alias("sum_sq"))
    rows = u.agg(F.count(F.lit(1)).alias("n"), F.sum(V.sqnorm("u")).alias("nn"),
                 F.sum(F.pow(V.sqnorm("u"), 2)).alias("nn2"))
    g = gram(u).agg(F.sum(F.col("g") * F.col("g")).alias("fro"))
    j = zip_rows(rows, s1, g)
    n2 = F.col("n").cast("double") * F.col("n")
    mean = (F.col("sum_sq") - F.col("nn")) / n2
    sum_c2 = F.col("fro") - F.col("nn2")
    var = F.when(n2 > 1, (sum_c2 - n2 * mean * mean) / (n2 - 1))  # one vector: undefined
    return j.select(mean.alias("e_costheta"), var.alias("v_costheta"))


_PAIR_STATS = T.StructType([
    T.StructField("cnt", T.LongType()), T.StructField("e_t2", T.DoubleType()),
    T.StructField("e_raw_t2", T.DoubleType()), T.StructField("e_t1", T.DoubleType()),
    T.StructField("min_cos", T.DoubleType()), T.StructField("hist", T.ArrayType(T.LongType()))])


PAIR_STATS = ("uniform_t2", "uniform_raw_t2", "uniform_t1", "gamma", "off_hist")
TILE = 128, 1024  # rows of a pair of blocks that are handled at a time, so that a step stays in the cache


def _cosine_bins(cos: np.ndarray) -> np.ndarray:
    """Values in [-1, 1] by bin; 1.0 falls in the last, others are ignored."""
    if not (cos.min() >= -1 and cos.max() <= 1):
        cos = cos[(cos >= -1) & (cos <= 1)]
    at = cos + 1
    at *= HIST_BINS / 2.0
    found = np.bincount(at.astype(np.intp).ravel(), minlength=HIST_BINS + 1)
    found[HIST_BINS - 1] += found[HIST_BINS]
    return found[:HIST_BINS]


def _kernel_sums(dots: np.ndarray, a: np.ndarray, b: np.ndarray, twice: bool) -> np.ndarray:
    """exp(-d^2), or exp(-2 d^2) if ``twice``, of squared distances a + b - 2 dots; in place of ``dots``."""
    dots *= 2.0
    dots -= a[:, None]
    dots -= b
    np.minimum(dots, 0.0, out=dots)
    if twice:
        dots *= 2.0
    return np.exp(dots, out=dots)


def _pair_stats(stats):
    """Of the wanted ``stats``: uniformity sums, min cosine and histogram over a task's block pairs (numpy), as one row.

    Squared distances use |a|^2 + |b|^2 - 2 a.b from one matrix product, a tile at a time; with x = u r, a.b is r_a r_b times the cosine."""
    unit, raw = "uniform_t1" in stats or "uniform_t2" in stats, "uniform_raw_t2" in stats

    def run(pairs):
        cnt, sums, low, hist = 0, np.zeros(3), None, np.zeros(HIST_BINS, dtype="int64")
        for lb, lt, rb, rt in pairs:
            low = np.inf if low is None else low
            (xl, rl), (xr, rr) = ((t["x"], t["r"]) for t in (lt, rt))
            ul, ur = xl / rl[:, None], xr / rr[:, None]
            a, b, ra, rb2 = ((v * v).sum(1) for v in (ul, ur, xl, xr))
            for i in range(0, len(ul), TILE[0]):
                s = slice(i, i + TILE[0])
                for j in range(0, len(ur), TILE[1]):
                    to = slice(j, j + TILE[1])
                    if lb == rb and i >= min(j + TILE[1], len(ur)) - 1:
                        continue  # below the diagonal
                    cos = ul[s] @ ur[to].T
                    half = None
                    if lb == rb and i + TILE[0] > j:
                        half = np.arange(i, i + len(cos))[:, None] < np.arange(j, j + cos.shape[1])
                    seen = cos if half is None else cos[half]
                    if not seen.size:
                        continue
                    cnt += seen.size
                    if "gamma" in stats:
                        low = np.minimum(low, seen.min())
                    if "off_hist" in stats:
                        hist += _cosine_bins(seen)
                    if raw:
                        dots = cos * rl[s, None]
                        dots *= rr[to]
                        e = _kernel_sums(dots, ra[s], rb2[to], True)
                        sums[1] += (e if half is None else e[half]).sum()
                    if unit:
                        e = _kernel_sums(cos, a[s], b[to], False)
                        e = e.ravel() if half is None else e[half]
                        sums[2] += e.sum()
                        sums[0] += e @ e
        if low is not None:
            yield pd.DataFrame({"cnt": [cnt], "e_t2": [sums[0]], "e_raw_t2": [sums[1]], "e_t1": [sums[2]],
                                "min_cos": [float(low) if cnt and "gamma" in stats else None], "hist": [hist.tolist()]})
    return run


def pair_statistics(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                    block_rows: int = 4096, stats: tuple[str, ...] = PAIR_STATS) -> DataFrame:
    """Q2 + Q5 + Q6 partials of every unordered pair in one blocked numpy pass.

    One row: uniform_t2, uniform_raw_t2, uniform_t1, gamma, off_hist (pair
    counts per bin, each unordered pair once), n; of the first five only ``stats``.
    """
    u = df.select(F.col(id_col).alias("id"), F.col(vec).alias("x"), F.greatest(V.norm(vec), F.lit(1e-12)).alias("r"))
    # a row for each task, kept: the bins and the sums are two aggregates of one pass
    parts = cut_lineage(block_sweep(u, "id", ["x", "r"], _pair_stats(stats), _PAIR_STATS, block_rows))
    # bins summed distributively (20 groups), then one ordered array of 20 counts
    bins = (parts.select(F.posexplode("hist").alias("bin", "c")).groupBy("bin").agg(F.sum("c").alias("c"))
            .agg(F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("_h")).select(F.col("_h.c").alias("h")))
    agg = parts.agg(F.sum("cnt").alias("cnt"), F.sum("e_t2").alias("e_t2"), F.sum("e_raw_t2").alias("e_raw"),
                    F.sum("e_t1").alias("e_t1"), F.min("min_cos").alias("min_cos"))
    hist = F.coalesce(bins.scalar(), F.array_repeat(F.lit(0).cast("long"), HIST_BINS))
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    has = F.col("cnt") > 0  # a single vector has no pairs
    out = {"uniform_t2": F.when(has, F.log(F.col("e_t2") / F.col("cnt"))),
           "uniform_raw_t2": F.when(has, F.log(F.col("e_raw") / F.col("cnt"))),
           "uniform_t1": F.when(has, F.log(F.col("e_t1") / F.col("cnt"))),
           "gamma": F.acos(F.least(F.coalesce("min_cos", F.lit(0.0)), F.lit(0.0))),
           "off_hist": hist}
    return agg.select(*[c.alias(s) for s, c in out.items() if s in stats], n.alias("n"))


def uniformity(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
               block_rows: int = 4096) -> DataFrame:
    """Q2: ln mean_{i<j} exp(-t ||x_i - x_j||^2) in its three variants."""
    wanted = ("uniform_t2", "uniform_raw_t2", "uniform_t1")
    return pair_statistics(df, id_col, vec, block_rows, wanted).select(*wanted)


def widest_angle(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                 block_rows: int = 4096) -> DataFrame:
    """Q5: acos(min cosine entry), the zero diagonal included (so at least pi/2)."""
    return pair_statistics(df, id_col, vec, block_rows, ("gamma",)).select("gamma")


def cosine_histogram(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                     block_rows: int = 4096) -> DataFrame:
    """Q6: 20 equal bins on [-1, 1] over all N^2 entries (zero diagonal in bin 10).

    Off-diagonal pairs count twice (the matrix is symmetric); values outside
    [-1, 1] are ignored and 1.0 falls in the last bin.
    """
    st = pair_statistics(df, id_col, vec, block_rows, ("off_hist",))
    return st.select(F.posexplode("off_hist").alias("bin", "c"), "n").select(
        F.col("bin").cast("int").alias("bin"),
        (F.col("c") * 2 + F.when(F.col("bin") == HIST_BINS // 2, F.col("n")).otherwise(F.lit(0)))
        .cast("bigint").alias("count"))


def drawn_pairs(spark, n: int, draws: int, strata: int, seed: int = 0) -> DataFrame:
    """(draw, stratum, i, j): ``draws`` ordered pairs of different positions below n, the same number (up to one) in each stratum of i.

    A stratum is a run of n / strata positions; i is uniform in it and j among all others, both from md5 draws, so the sample depends on
    the seed alone.
    """
    t, h = F.col("draw"), F.col("stratum")
    bound = lambda k: F.floor(k * F.lit(n) / F.lit(strata)).cast("bigint")
    d = spark.range(draws).select(F.col("id").alias("draw"), F.pmod("id", F.lit(strata)).alias("stratum"))
    pick = lambda name, m: F.shiftright(hash_u32(F.lit(seed), F.lit(name), t) * m, 32)
    d = d.withColumn("i", bound(h) + pick("left", bound(h + 1) - bound(h)))
    return d.withColumn("j", F.pmod(F.col("i") + 1 + pick("right", F.lit(n - 1)), F.lit(n)))


def sampled_uniformity(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", t: float = 2.0, draws: int = 100_000, strata: int = 256, seed: int = 0) -> DataFrame:
    """Q2 for large tables: (n_draws, uniform, se), the log mean of exp(-t |x^ - y^|^2) over pairs from ``draws`` sampled ones.

    The mean of the strata, weighted by their share of the rows, is unbiased for the mean over all pairs; ``se`` is the standard error of
    its logarithm from the variance within strata.  Work is linear in rows and draws: rows get a dense position once and two equi-joins
    bring the vectors to the pairs.  Needs two rows, at least two draws for each stratum, fewer than 2^31 rows a stratum; else nulls.
    """
    u = dense_index(normalized(df, id_col, vec).select("id", "u"), ["id"], name="pos")
    n = u.count()
    strata = max(1, min(strata, n, draws // 2))
    if n < 2 or draws < 2:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n_draws"), F.lit(None).cast("double").alias("uniform"), F.lit(None).cast("double").alias("se"))
    p = drawn_pairs(df.sparkSession, n, draws, strata, seed)
    p = p.join(u.select(F.col("pos").alias("i"), F.col("u").alias("a")), "i").join(u.select(F.col("pos").alias("j"), F.col("u").alias("b")), "j")
    f = F.exp(F.lit(-t) * F.pow(V.norm(V.sub("a", "b")), F.lit(2.0)))
    per = p.groupBy("stratum").agg(F.count(F.lit(1)).alias("m"), F.avg(f).alias("f"), F.var_samp(f).alias("v"))
    share = (F.floor((F.col("stratum") + 1) * F.lit(n) / F.lit(strata)) - F.floor(F.col("stratum") * F.lit(n) / F.lit(strata))) / F.lit(n)
    mean, var = F.sum(share * F.col("f")), F.sum(share * share * F.col("v") / F.col("m"))
    return per.agg(F.sum("m").alias("n_draws"), F.log(mean).alias("uniform"), (F.sqrt(var) / mean).alias("se"))

"""Ranking and variant scores (V1-V6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.hashing import hash_u32
from helixframe.operators.common import scalar_struct
from helixframe.operators.indexing import dense_index, running_agg


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """V1."""
    return df.agg(F.corr(a, b).alias("pearson_corr"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label",
                      group_cols: list[str] | None = None) -> DataFrame:
    """V2/V3: sum over distinct thresholds (descending) of precision x recall step.

    Rows are first aggregated per (group, score) - ties form one threshold -
    then cumulative sums run in score order with the skew-proof running scan.
    Output: group columns, n, auprc.
    """
    g = list(group_cols or [])
    per = df.groupBy(*g, score).agg(F.sum(F.col(label).cast("double")).alias("tp"),
                                    F.count(F.lit(1)).cast("double").alias("cnt"))
    per = per.withColumn("_neg", -F.col(score))
    cum = running_agg(per, ["tp", "cnt"], ["_neg"], g, op="sum", name=["ctp", "ccnt"])
    tot = per.groupBy(*g).agg(F.sum("tp").alias("ptot"), F.sum("cnt").cast("bigint").alias("n"))
    if g:
        j = cum.join(tot, g)
    else:
        s = scalar_struct(tot)
        j = cum.select("*", s.getField("ptot").alias("ptot"), s.getField("n").alias("n"))
    term = F.when(F.col("tp") > 0, F.col("ctp") / F.col("ccnt") * F.col("tp") / F.col("ptot")) \
        .otherwise(F.lit(0.0))
    return j.groupBy(*g).agg(F.first("n").alias("n"), F.sum(term).alias("auprc"))


def weighted_mean(groups: DataFrame, value: str = "auprc", weight: str = "n") -> DataFrame:
    """V4: sum(value * n) / sum(n)."""
    return groups.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_auprc"))


def bootstrap_se(groups: DataFrame, order_col: str, reps: int = 1000, seed: int = 0,
                 value: str = "auprc", weight: str = "n") -> DataFrame:
    """V5: sample std over ``reps`` resamples (with replacement) of the group rows of V4.

    Draw q of replicate r picks row floor(u(seed, r, q) * m).  Reps x draws
    come from ``spark.range(reps * m)``: the work grows with reps * m and no
    loop runs on the driver.
    """
    spark = groups.sparkSession
    idx = dense_index(groups, [order_col], name="row")
    m = groups.count()  # scalar
    draws = spark.range(reps * m).select(
        F.expr(f"id div {max(m, 1)}").alias("rep"), (F.col("id") % F.lit(max(m, 1))).alias("q"))
    draws = draws.withColumn(
        "row", (hash_u32(F.lit(seed), F.col("rep"), F.col("q")) * F.lit(m) / F.lit(4294967296)).cast("bigint"))
    picked = draws.join(idx.select("row", value, weight), "row")
    per_rep = picked.groupBy("rep").agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("stat"))
    return per_rep.agg(F.stddev_samp("stat").alias("weighted_auprc_bootstrap_se"))


def score_histogram(df: DataFrame, score: str = "score", label: str = "label",
                    bins: int = 30) -> DataFrame:
    """V6: common bins on [min, max]; density per label = count / (n_label * width)."""
    # equal min and max: the range widens to (v - 0.5, v + 0.5) as in numpy
    mm = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    lo = mm.select("lo").scalar()
    hi = mm.select("hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    b = F.least(F.floor((F.col(score) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(label, b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    nl = df.groupBy(label).agg(F.count(F.lit(1)).alias("nl"))
    return counts.join(nl, label).select(
        label, "bin", (F.col("c") / (F.col("nl") * width)).alias("density"))

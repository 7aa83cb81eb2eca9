"""In-batch contrastive analytics (similarity blocks and losses).

Input: a batch table ``(batch, pos, z1, z2[, z3])``.  Pairs are formed by a
self equi-join on ``batch`` only (N^2 rows per batch, never a global cross
product); the wrap-around neighbour is a ``lead`` over the batch with the
first row as fallback.  Batches have a bounded size, so the per-batch
windows cannot be skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import vectors as V


BLOCKS = ("A", "H", "B", "D")
_STEP = 256.0


def with_neighbours(batches: DataFrame, lam: float) -> DataFrame:
    """Adds N, the mixed negatives n = lam z2 + (1-lam) z2_next and anchors a = lam z1 + (1-lam) z1_next."""
    w = Window.partitionBy("batch").orderBy("pos")
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = batches.select(
        "*",
        F.count(F.lit(1)).over(wall).alias("n"),
        F.coalesce(F.lead("z2").over(w), F.first("z2").over(wall)).alias("_z2n"),
        F.coalesce(F.lead("z1").over(w), F.first("z1").over(wall)).alias("_z1n"))
    return b.select(*batches.columns, "n", V.mix("z2", "_z2n", lam).alias("zmix"),
                    V.mix("z1", "_z1n", lam).alias("amix"))


def unit(x) -> Column:
    """The vector over its norm (1e-8 at least), so that a dot product of two units is their cosine."""
    return V.l2_normalize(x, 1e-8)


def positive_logits(batches: DataFrame, temp: float = 0.05, pos_m: float = 0.0) -> DataFrame:
    """(batch, i, logit): the diagonal of block A, row by row without forming pairs."""
    return batches.select("batch", F.col("pos").alias("i"), (V.cosine("z1", "z2") / F.lit(temp) - F.lit(pos_m / temp)).alias("logit"))


def logits(batches: DataFrame, temp: float = 0.05, lam: float = 0.2, pos_m: float = 0.0,
           hard_negative_weight: float = 0.0, num_sent: int = 2, blocks=BLOCKS) -> DataFrame:
    """Tall logits table (batch, i, block, j, logit) of the wanted blocks among A, [H], B, D.

    A_ij = cos(z1_i, z2_j)/t - [i=j] m/t
    H_ij = cos(z1_i, z3_j)/t + [i=j] w            (num_sent >= 3; w only if == 3)
    B_ij = [j != i-1] cos(z1_i, n_j)/t + [i=j] w  (masked cells are 0, not -inf)
    D_ij = [j != i+1] cos(a_i, z2_j)/t + [i=j] w

    Vectors are normalised once per row; a pair costs one dot product per block, and a side
    carries only the vectors that its blocks read.
    """
    has3 = num_sent >= 3 and "z3" in batches.columns
    blocks = [b for b in BLOCKS if b in blocks and (b != "H" or has3)]
    if set(blocks) & {"B", "D"}:
        b = with_neighbours(batches, lam)
    else:
        b = batches.withColumn("n", F.lit(0))
    sides = {"A": ("z1", "z2"), "H": ("z1", "z3"), "B": ("z1", "zmix"), "D": ("amix", "z2")}
    named = lambda side: sorted({sides[x][side] for x in blocks})
    left = b.select("batch", F.col("pos").alias("i"), "n", *[unit(c).alias("l_" + c) for c in named(0)])
    right = b.select("batch", F.col("pos").alias("j"), *[unit(c).alias("r_" + c) for c in named(1)])
    # the units are written out by the exchange of the join, not folded again for each pair
    j = left.repartition("batch").join(right.repartition("batch"), "batch")
    i_, j_, n = F.col("i"), F.col("j"), F.col("n")
    w = F.when(i_ == j_, F.lit(hard_negative_weight)).otherwise(F.lit(0.0))
    extra = {"A": -F.when(i_ == j_, F.lit(pos_m / temp)).otherwise(F.lit(0.0)), "H": w if num_sent == 3 else F.lit(0.0), "B": w, "D": w}
    masked = {"B": j_ == F.pmod(i_ - 1, n), "D": j_ == F.pmod(i_ + 1, n)}
    cells = []
    for x in blocks:
        cos = V.dot("l_" + sides[x][0], "r_" + sides[x][1]) / F.lit(temp)
        cos = F.when(masked[x], F.lit(0.0)).otherwise(cos) if x in masked else cos
        cells.append(F.struct(F.lit(x).alias("block"), (cos + extra[x]).alias("logit")))
    return j.select("batch", "i", "j", F.explode(F.array(*cells)).alias("_b")).select(
        "batch", "i", F.col("_b.block").alias("block"), "j", F.col("_b.logit").alias("logit"))


def row_losses(lg: DataFrame) -> DataFrame:
    """C6 per anchor row: logsumexp over all blocks minus the A diagonal."""
    w = Window.partitionBy("batch", "i")
    m = lg.withColumn("_m", F.max("logit").over(w))
    return m.groupBy("batch", "i").agg(
        (F.first("_m") + F.log(F.sum(F.exp(F.col("logit") - F.col("_m"))))
         - F.max(F.when((F.col("block") == "A") & (F.col("i") == F.col("j")), F.col("logit"))))
        .alias("loss"))


def batch_losses(lg: DataFrame) -> DataFrame:
    return row_losses(lg).groupBy("batch").agg(F.avg("loss").alias("loss"))


def masked_lm_loss(lg: DataFrame, label_col: str = "label") -> DataFrame:
    """Mean over labelled positions (label != -100) of -log softmax(label).

    ``lg`` is (seq, pos, vocab, logit, label); rows of ignored positions drop
    first.  The exponentials of a position are summed before the shuffle, relative
    to the nearest multiple of ``_STEP``, which neither overflows nor vanishes;
    the few sums of a position then meet relative to its largest multiple.
    """
    x = lg.where(F.col(label_col) != -100)
    logit = F.col("logit")
    finite = F.abs(logit) < F.lit(float("inf"))
    near = F.when(finite, F.rint(logit / _STEP) * _STEP).otherwise(logit)
    x = x.select("seq", "pos", near.alias("_s"), F.when(F.abs(logit) == F.lit(float("inf")), 1.0).otherwise(F.exp(logit - near)).alias("_p"),
                 F.when(F.col("vocab") == F.col(label_col), logit).alias("_own"))
    sums = x.groupBy("seq", "pos", "_s").agg(F.sum("_p").alias("_p"), F.max("_own").alias("_own"))
    m = sums.withColumn("_m", F.max("_s").over(Window.partitionBy("seq", "pos")))
    per = m.groupBy("seq", "pos").agg((F.first("_m") + F.log(F.sum(F.col("_p") * F.exp(F.col("_s") - F.col("_m")))) - F.max("_own")).alias("nll"))
    return per.agg(F.avg("nll").alias("mlm_loss"))


def with_masked_lm(loss: DataFrame, mlm: DataFrame, weight: float = 0.1) -> DataFrame:
    """C7 combination: loss + weight * mlm_loss, the one-row MLM loss joining as a scalar."""
    return loss.withColumn("loss", F.col("loss") + F.lit(weight) * mlm.select("mlm_loss").scalar())


def gaussian_weighted_loss(batches: DataFrame, temp: float = 0.05, mu: float = 0.0,
                           sigma: float = 1.0) -> DataFrame:
    """C8 per batch: -mean_i log(exp(s_ii) / sum_j w_ij exp(s_ij)).

    s = cos/temp; w_ij = N(s_ij * 0.05; mu, sigma) divided by its row mean.
    """
    left = batches.select("batch", F.col("pos").alias("i"), unit("z1").alias("z1")).repartition("batch")
    right = batches.select("batch", F.col("pos").alias("j"), unit("z2").alias("z2")).repartition("batch")
    s = left.join(right, "batch").select("batch", "i", "j", (V.dot("z1", "z2") / F.lit(temp)).alias("s"))
    g = (F.lit(1.0 / (sigma * (2 * 3.141592653589793) ** 0.5))
         * F.exp(-F.pow(F.col("s") * F.lit(0.05) - F.lit(mu), 2) / F.lit(2 * sigma * sigma)))
    wrow = Window.partitionBy("batch", "i")
    sw = s.withColumn("w", g).withColumn("w", F.col("w") / F.avg("w").over(wrow)).withColumn("_m", F.max("s").over(wrow))
    per = sw.groupBy("batch", "i").agg(
        (F.max("_m") + F.log(F.sum(F.exp(F.col("s") - F.col("_m")) * F.col("w"))) - F.max(F.when(F.col("i") == F.col("j"), F.col("s"))))
        .alias("loss"))
    return per.groupBy("batch").agg(F.avg("loss").alias("loss"))

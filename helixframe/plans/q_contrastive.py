"""Contrastive plans (C1-C8) over the batch fixture F10.

Fixed loss parameters for these plans: temp 0.05, lambda 0.2, and the
non-default pos_m 0.1 and hard-negative weight 0.5 so that every term of the
loss is exercised.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import contrastive as C
from helixframe.operators.common import r6
from helixframe.plans.registry import query
from helixframe.plans.sqlfix import BATCHES, cos_sql, mix_sql
from helixframe.sources import fixtures as FX

TEMP, LAM, POS_M, HNW = 0.05, 0.2, 0.1, 0.5

_NB = f"""WITH b AS ({BATCHES}),
nb AS (SELECT b.*, {mix_sql('b.z2', 'nx.z2', LAM)} AS zmix, {mix_sql('b.z1', 'nx.z1', LAM)} AS amix
       FROM b JOIN b nx ON nx.batch = b.batch AND nx.pos = (b.pos + 1) % b.n),
pr AS (SELECT l.batch, l.pos AS i, r.pos AS j, l.n,
              {cos_sql('l.z1', 'r.z2')} / {TEMP} AS c_a,
              {cos_sql('l.z1', 'r.z3')} / {TEMP} AS c_h,
              {cos_sql('l.z1', 'r.zmix')} / {TEMP} AS c_b,
              {cos_sql('l.amix', 'r.z2')} / {TEMP} AS c_d
       FROM nb l JOIN nb r ON l.batch = r.batch),
lg AS (
  SELECT batch, i, 'A' AS block, j, c_a - CASE WHEN i = j THEN {POS_M / TEMP!r} ELSE 0.0 END AS logit FROM pr
  UNION ALL SELECT batch, i, 'H', j, c_h + CASE WHEN i = j THEN {HNW} ELSE 0.0 END FROM pr
  UNION ALL SELECT batch, i, 'B', j, CASE WHEN j = (i - 1 + n) % n THEN 0.0 ELSE c_b END
                                     + CASE WHEN i = j THEN {HNW} ELSE 0.0 END FROM pr
  UNION ALL SELECT batch, i, 'D', j, CASE WHEN j = (i + 1) % n THEN 0.0 ELSE c_d END
                                     + CASE WHEN i = j THEN {HNW} ELSE 0.0 END FROM pr)"""


def _logits(spark, sf, pos_m=POS_M, hnw=HNW, blocks=C.BLOCKS):
    return C.logits(FX.contrastive_batches(spark, sf, with_z3="H" in blocks), temp=TEMP, lam=LAM, pos_m=pos_m,
                    hard_negative_weight=hnw, num_sent=3, blocks=blocks)


def _block(spark, sf, block):
    lg = _logits(spark, sf, blocks=(block,))
    return lg.select("batch", "i", "j", r6("logit").alias("logit"))


def _block_sql(block):
    return f"{_NB} SELECT batch, i, j, round(logit, 6) + 0.0 AS logit FROM lg WHERE block = '{block}'"


@query("c1_similarity_matrix", f"""{_NB}
SELECT batch, i, j, round(c_a, 6) + 0.0 AS logit FROM pr""")
def c1_similarity_matrix(spark, sf):
    lg = _logits(spark, sf, pos_m=0.0, blocks=("A",))
    return lg.select("batch", "i", "j", r6("logit").alias("logit"))


@query("c2_positive_margin", f"""{_NB}
SELECT batch, i, round(logit, 6) + 0.0 AS logit FROM lg WHERE block = 'A' AND i = j""")
def c2_positive_margin(spark, sf):
    lg = C.positive_logits(FX.contrastive_batches(spark, sf, with_z3=False), TEMP, POS_M)
    return lg.select("batch", "i", r6("logit").alias("logit"))


query("c3_hard_negative_block", _block_sql("H"))(lambda spark, sf: _block(spark, sf, "H"))
query("c4_mixed_negatives", _block_sql("B"))(lambda spark, sf: _block(spark, sf, "B"))
query("c5_mixed_anchors", _block_sql("D"))(lambda spark, sf: _block(spark, sf, "D"))


_LOSS_SQL = f"""{_NB},
rl AS (SELECT batch, i, max(logit) + ln(sum(exp(logit - mx))) - max(CASE WHEN block = 'A' AND i = j THEN logit END) AS loss
       FROM (SELECT *, max(logit) OVER (PARTITION BY batch, i) AS mx FROM lg) GROUP BY batch, i)"""


@query("c6_contrastive_loss", f"""{_LOSS_SQL}
SELECT batch, round(avg(loss), 6) + 0.0 AS loss FROM rl GROUP BY batch""")
def c6_contrastive_loss(spark, sf):
    return C.batch_losses(_logits(spark, sf)).select("batch", r6("loss").alias("loss"))


LOSS_BY_BATCH_SQL = f"{_LOSS_SQL} SELECT batch, avg(loss) AS loss FROM rl GROUP BY batch"
all_logits = _logits

MU, SIGMA = 0.0, 0.5


@query("c8_gaussian_val_loss", f"""
WITH b AS ({BATCHES}),
s AS (SELECT l.batch, l.pos AS i, r.pos AS j, {cos_sql('l.z1', 'r.z2')} / {TEMP} AS s
      FROM b l JOIN b r ON l.batch = r.batch),
w AS (SELECT *, {1.0 / (SIGMA * (2 * 3.141592653589793) ** 0.5)!r} * exp(-pow(s * 0.05 - {MU}, 2) / {2 * SIGMA * SIGMA}) AS g FROM s),
wn AS (SELECT *, g / avg(g) OVER (PARTITION BY batch, i) AS wt FROM w),
per AS (SELECT batch, i, ln(sum(exp(s) * wt)) - max(CASE WHEN i = j THEN s END) AS loss FROM wn GROUP BY batch, i)
SELECT batch, round(avg(loss), 6) + 0.0 AS loss FROM per GROUP BY batch""")
def c8_gaussian_val_loss(spark, sf):
    b = FX.contrastive_batches(spark, sf, with_z3=False)
    return C.gaussian_weighted_loss(b, TEMP, MU, SIGMA).select("batch", r6("loss").alias("loss"))

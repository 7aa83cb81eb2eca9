"""Ranking (V1-V6) and run/trial log (X1-X9) plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import ranking as RK
from helixframe.operators import runs as RU
from helixframe.operators.common import r6
from helixframe.operators.shape import batch_plan  # noqa: F401
from helixframe.operators.indexing import dense_index
from helixframe.plans.registry import query
from helixframe.sources import fixtures as FX
from helixframe.sources.tables import table

VAR_SQL = """SELECT l.doc_id,
  floor(('0x' || substr(md5(concat_ws(':', 'score', CAST(l.doc_id AS VARCHAR))), 1, 8))::BIGINT * 100 / 4294967296)
    / 100.0::DOUBLE AS score,
  d.n_chars::DOUBLE AS precomputed_score, l.quality::INTEGER AS label, d.lang AS chrom
FROM labels l JOIN documents d USING (doc_id)"""

_AP_SQL = """WITH v AS ({v}),
s AS (SELECT {g} score, sum(label)::DOUBLE AS tp, count(*)::DOUBLE AS cnt FROM v GROUP BY {g} score),
c AS (SELECT {g} tp, cnt,
             sum(tp) OVER (PARTITION BY {p} ORDER BY score DESC) AS ctp,
             sum(cnt) OVER (PARTITION BY {p} ORDER BY score DESC) AS ccnt,
             sum(tp) OVER (PARTITION BY {p}) AS ptot, sum(cnt) OVER (PARTITION BY {p}) AS n FROM s)
SELECT {g} max(n)::BIGINT AS n, sum(CASE WHEN tp > 0 THEN ctp / ccnt * tp / ptot ELSE 0.0 END) AS auprc
FROM c {gb}"""


def ap_sql(by_group: bool) -> str:
    if by_group:
        return _AP_SQL.format(v=VAR_SQL, g="chrom,", p="chrom", gb="GROUP BY chrom")
    return _AP_SQL.format(v=VAR_SQL, g="", p="1", gb="")


def _var(spark, sf):
    return FX.variant_scores(spark, sf)


@query("v1_pearson", f"SELECT round(corr(score, precomputed_score), 6) + 0.0 AS pearson_corr FROM ({VAR_SQL})")
def v1_pearson(spark, sf):
    return RK.pearson(_var(spark, sf), "score", "precomputed_score").select(
        r6("pearson_corr").alias("pearson_corr"))


@query("v2_average_precision", f"SELECT round(auprc, 6) + 0.0 AS global_auprc FROM ({ap_sql(False)})")
def v2_average_precision(spark, sf):
    return RK.average_precision(_var(spark, sf)).select(r6("auprc").alias("global_auprc"))


@query("v3_ap_by_group", f"SELECT chrom, n, round(auprc, 6) + 0.0 AS auprc FROM ({ap_sql(True)})")
def v3_ap_by_group(spark, sf):
    a = RK.average_precision(_var(spark, sf), group_cols=["chrom"])
    return a.select("chrom", "n", r6("auprc").alias("auprc"))


@query("v4_weighted_ap", f"""
SELECT round(sum(auprc * n) / sum(n), 6) + 0.0 AS weighted_auprc FROM ({ap_sql(True)})""")
def v4_weighted_ap(spark, sf):
    a = RK.average_precision(_var(spark, sf), group_cols=["chrom"])
    return RK.weighted_mean(a).select(r6("weighted_auprc").alias("weighted_auprc"))


REPS = 1000


@query("v5_bootstrap_se", f"""
WITH g AS (SELECT *, row_number() OVER (ORDER BY chrom) - 1 AS row FROM ({ap_sql(True)})),
m AS (SELECT count(*) AS m FROM g),
d AS (SELECT r.id // m.m AS rep, r.id % m.m AS q, m.m FROM range((SELECT {REPS} * m FROM m)) r(id), m),
p AS (SELECT rep, floor(('0x' || substr(md5(concat_ws(':', '0', CAST(rep AS VARCHAR), CAST(q AS VARCHAR))), 1, 8))::BIGINT
                   * m / 4294967296)::BIGINT AS row FROM d),
s AS (SELECT rep, sum(auprc * n) / sum(n) AS stat FROM p JOIN g USING (row) GROUP BY rep)
SELECT round(stddev_samp(stat), 6) + 0.0 AS weighted_auprc_bootstrap_se FROM s""")
def v5_bootstrap_se(spark, sf):
    a = RK.average_precision(_var(spark, sf), group_cols=["chrom"])
    return RK.bootstrap_se(a, "chrom", REPS, seed=0).select(
        r6("weighted_auprc_bootstrap_se").alias("weighted_auprc_bootstrap_se"))


@query("v6_score_histogram", f"""
WITH v AS ({VAR_SQL}), mm AS (SELECT min(score) AS lo, max(score) AS hi FROM v),
b AS (SELECT label, least(floor((score - lo) / ((hi - lo) / 30.0::DOUBLE)), 29)::INTEGER AS bin FROM v, mm),
nl AS (SELECT label, count(*) AS nl FROM v GROUP BY label)
SELECT b.label, b.bin, round(count(*) / (max(nl.nl) * max((hi - lo) / 30.0::DOUBLE)), 6) + 0.0 AS density
FROM b JOIN nl USING (label), mm GROUP BY b.label, b.bin""")
def v6_score_histogram(spark, sf):
    h = RK.score_histogram(_var(spark, sf))
    return h.select("label", "bin", r6("density").alias("density"))


# ---------------------------------------------------------------- run logs
LOG_SQL = """SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
  ts, event_id, event_type AS metric, value FROM events"""
LOG_NAN_SQL = LOG_SQL.replace("value FROM events",
                              "CASE WHEN event_id % 13 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM events")
TRIALS_SQL = """SELECT user_id AS trial, max(value) AS value,
  CASE WHEN user_id % 2 = 0 THEN 'COMPLETE' ELSE 'PRUNED' END AS state FROM events GROUP BY user_id"""


def _log(spark, sf, nan=False):
    return RU.metric_log(table(spark, sf, "events"), nan_every=13 if nan else None)


def _trials(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("trial")).agg(F.max("value").alias("value")).withColumn(
        "state", F.when(F.col("trial") % 2 == 0, F.lit("COMPLETE")).otherwise(F.lit("PRUNED")))


@query("x1_metric_prefix", f"""
SELECT run, step, CASE WHEN starts_with(metric, 'eval_') THEN metric ELSE 'eval_' || metric END AS metric, value
FROM ({LOG_SQL})""")
def x1_metric_prefix(spark, sf):
    return RU.prefix_metric(_log(spark, sf)).select("run", "step", "metric", "value")


@query("x2_best_so_far", f"""
SELECT run, step, value FROM (
  SELECT *, max(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM ({LOG_SQL})) WHERE prev IS NULL OR value > prev""")
def x2_best_so_far(spark, sf):
    return RU.best_so_far(_log(spark, sf)).select("run", "step", "value")


CKPT_SQL = f"SELECT run, step, value, 'checkpoint-' || step AS path FROM ({LOG_SQL}) WHERE step % 5 = 0"


@query("x3_stale_checkpoints", f"""
WITH c AS ({CKPT_SQL}),
b AS (SELECT run, step FROM (SELECT *, max(value) OVER (PARTITION BY run ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c) WHERE prev IS NULL OR value > prev),
last AS (SELECT run, max(step) AS step FROM b GROUP BY run)
SELECT c.run, c.step, c.path FROM c ANTI JOIN last USING (run, step)""")
def x3_stale_checkpoints(spark, sf):
    c = _log(spark, sf).where(F.col("step") % 5 == 0).select(
        "run", "step", "value", F.concat(F.lit("checkpoint-"), F.col("step").cast("string")).alias("path"))
    return RU.stale_checkpoints(c).select("run", "step", "path")


@query("x4_best_trial", f"""
WITH t AS ({TRIALS_SQL})
SELECT (SELECT trial FROM t WHERE state = 'COMPLETE' ORDER BY value DESC, trial LIMIT 1) AS best_trial,
       (SELECT max(value) FROM t WHERE state = 'COMPLETE') AS best_value,
       (SELECT count(*) FROM t) AS n_trials, 30 - (SELECT count(*) FROM t) AS trials_left""")
def x4_best_trial(spark, sf):
    return RU.best_trial(_trials(spark, sf))


@query("x5_median_pruning", f"""
WITH l AS ({LOG_SQL}), t AS ({TRIALS_SQL}),
x AS (SELECT l.run AS trial, l.step, l.value, t.state FROM l JOIN t ON t.trial = l.run),
med AS (SELECT step, median(value) AS median FROM x WHERE state = 'COMPLETE' GROUP BY step),
r AS (SELECT trial, step, max(value) OVER (PARTITION BY trial ORDER BY step ROWS UNBOUNDED PRECEDING) AS best
      FROM x WHERE state <> 'COMPLETE')
SELECT r.trial, r.step, round(best, 6) + 0.0 AS best, round(median, 6) + 0.0 AS median,
       coalesce((SELECT count(*) FROM t WHERE state = 'COMPLETE') >= 5 AND median IS NOT NULL AND best < median, false) AS prune
FROM r LEFT JOIN med USING (step)""")
def x5_median_pruning(spark, sf):
    inter = _log(spark, sf).select(F.col("run").alias("trial"), "step", "value")
    p = RU.median_pruning(inter, _trials(spark, sf))
    return p.select("trial", "step", r6("best").alias("best"), r6("median").alias("median"), "prune")


@query("x6_loss_repair", f"""
WITH RECURSIVE w AS (SELECT run, (step - 1) // 10 AS log_window, (step - 1) % 10 AS q, value FROM ({LOG_NAN_SQL})),
r(run, log_window, q, acc) AS (
  SELECT run, log_window, q, CASE WHEN isnan(value) OR isinf(value) THEN 0.0::DOUBLE ELSE value END FROM w WHERE q = 0
  UNION ALL
  SELECT r.run, r.log_window, w.q, CASE WHEN isnan(w.value) OR isinf(w.value) THEN r.acc + r.acc / (w.q + 1)
                                    ELSE r.acc + w.value END
  FROM r JOIN w ON w.run = r.run AND w.log_window = r.log_window AND w.q = r.q + 1)
SELECT run, log_window, round(max_by(acc, q) / (max(q) + 1), 6) + 0.0 AS loss FROM r GROUP BY run, log_window""")
def x6_loss_repair(spark, sf):
    return RU.repair_losses(_log(spark, sf, nan=True), 10).select("run", "log_window", r6("loss").alias("loss"))


@query("x7_train_summary", f"""
SELECT run, round(sum(value::DECIMAL(38,10))::DOUBLE / max(step), 6) + 0.0 AS train_loss, max(step) AS steps,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE, 6) + 0.0 AS runtime,
       round(max(step) * 64 / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE), 6) + 0.0 AS samples_per_second,
       round(max(step) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE), 6) + 0.0 AS steps_per_second
FROM ({LOG_SQL}) GROUP BY run""")
def x7_train_summary(spark, sf):
    t = RU.train_summary(_log(spark, sf))
    return t.select("run", *[r6(c).alias(c) if c != "steps" else F.col(c)
                             for c in ["train_loss", "steps", "runtime", "samples_per_second",
                                       "steps_per_second"]])


@query("x8_eval_schedule", f"""
WITH l AS ({LOG_SQL}), k AS (SELECT run, ceil(max(step) * 0.1)::BIGINT AS k FROM l GROUP BY run)
SELECT l.run, l.step, l.value FROM l JOIN k USING (run) WHERE l.step % k.k = 0""")
def x8_eval_schedule(spark, sf):
    return RU.eval_schedule(_log(spark, sf), 0.1).select("run", "step", "value")


RESUME_STEP, RESUME_BATCH, RESUME_ACCUM = 7, 32, 2


@query("x9_resume_offset", f"""
WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {RESUME_BATCH} AS batch FROM documents),
s AS (SELECT greatest(count(DISTINCT batch) // {RESUME_ACCUM}, 1) AS spe FROM p)
SELECT doc_id, batch FROM p, s WHERE batch >= ({RESUME_STEP} % spe) * {RESUME_ACCUM}""")
def x9_resume_offset(spark, sf):
    d = dense_index(FX.documents(spark, sf).select("doc_id"), ["doc_id"])
    plan = d.select("doc_id", (F.col("idx") / RESUME_BATCH).cast("bigint").alias("batch"))
    return RU.resume_remaining(plan, RESUME_STEP, RESUME_ACCUM)

"""Run, trial and checkpoint logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.indexing import dense_index, running_agg


def metric_log(events: DataFrame, nan_every: int | None = None) -> DataFrame:
    """(run, step, ts, metric, value) - step is 1-based per run by (ts, event_id).

    Numbering uses the range-partitioned dense index, so a run holding a
    third of all rows is still spread over many tasks.
    """
    e = events.select(F.col("user_id").alias("run"), "ts", "event_id", "event_type", "value")
    if nan_every:
        e = e.withColumn("value", F.when(F.col("event_id") % nan_every == 0, F.lit(float("nan")))
                         .otherwise(F.col("value")))
    d = dense_index(e, ["ts", "event_id"], ["run"], name="idx")
    return d.select("run", (F.col("idx") + 1).alias("step"), "ts", "event_id",
                    F.col("event_type").alias("metric"), "value")


def prefix_metric(df: DataFrame, col: str = "metric", prefix: str = "eval_") -> DataFrame:
    """Add the prefix unless present."""
    return df.withColumn(col, F.when(F.col(col).startswith(prefix), F.col(col))
                         .otherwise(F.concat(F.lit(prefix), F.col(col))))


def best_so_far(df: DataFrame, value: str = "value", greater_is_better: bool = True,
                run: str = "run", step: str = "step") -> DataFrame:
    """Rows that are a new best: none before, or strictly better than all before."""
    op = "max" if greater_is_better else "min"
    r = running_agg(df, value, [step], [run], op=op, name="_prev", exclusive=True)
    better = (F.col(value) > F.col("_prev")) if greater_is_better else (F.col(value) < F.col("_prev"))
    return r.where(F.col("_prev").isNull() | better).drop("_prev")


def stale_checkpoints(ckpts: DataFrame, greater_is_better: bool = True) -> DataFrame:
    """Every checkpoint of a run except its best one (list only; nothing is deleted)."""
    best = best_so_far(ckpts, greater_is_better=greater_is_better)
    last = best.groupBy("run").agg(F.max("step").alias("step"))
    return ckpts.join(last, ["run", "step"], "left_anti")


def best_trial(trials: DataFrame, budget: int = 30) -> DataFrame:
    """Arg-max value over COMPLETE trials (lowest id on ties) and trials left."""
    comp = trials.where(F.col("state") == "COMPLETE")
    best = comp.agg(F.max_by("trial", F.struct(F.col("value"), -F.col("trial"))).alias("best_trial"),
                    F.max("value").alias("best_value"))
    n = trials.agg(F.count(F.lit(1)).alias("n_trials")).scalar()
    return best.select("best_trial", "best_value", n.alias("n_trials"),
                       (F.lit(budget) - n).alias("trials_left"))


def median_pruning(inter: DataFrame, trials: DataFrame, n_startup: int = 5) -> DataFrame:
    """Prune (trial, step) of unfinished trials when the trial's best value so far is
    below the median, over COMPLETE trials, of their value at that step; never before
    ``n_startup`` trials have completed.  (maximise direction)
    """
    states = trials.select("trial", "state")
    x = inter.join(states, "trial")
    done = x.where(F.col("state") == "COMPLETE")
    # median by rank: positions within a step come from the range-partitioned index, no step is gathered
    ranked = dense_index(done.select("step", "value", "trial"), ["value", "trial"], ["step"], name="_pos")
    size = done.groupBy("step").agg(F.count(F.lit(1)).alias("_n"))
    lo, hi = ((F.col("_n") - 1) / 2).cast("bigint"), (F.col("_n") / 2).cast("bigint")
    med = ranked.join(size, "step").where((F.col("_pos") == lo) | (F.col("_pos") == hi)).groupBy("step").agg(F.avg("value").alias("median"))
    n_done = states.where(F.col("state") == "COMPLETE").agg(F.count(F.lit(1))).scalar()
    run = x.where(F.col("state") != "COMPLETE")
    run = running_agg(run, "value", ["step"], ["trial"], op="max", name="best")
    j = run.join(med, "step", "left")
    prune = (n_done >= n_startup) & F.col("median").isNotNull() & (F.col("best") < F.col("median"))
    return j.select("trial", "step", "best", "median", F.coalesce(prune, F.lit(False)).alias("prune"))


def repair_losses(log: DataFrame, logging_steps: int = 10) -> DataFrame:
    """Per (run, log window) the logged loss with non-finite steps repaired.

    Within a window the accumulator adds the step loss, or - for nan/inf - its
    own value divided by (1 + steps since the last log).  The fold runs over
    one window at a time: at most ``logging_steps`` values per group.
    """
    w = log.select("run", ((F.col("step") - 1) / logging_steps).cast("bigint").alias("log_window"),
                   ((F.col("step") - 1) % logging_steps).cast("int").alias("q"), "value")
    g = w.groupBy("run", "log_window").agg(
        F.array_sort(F.collect_list(F.struct("q", "value"))).alias("xs"),
        F.count(F.lit(1)).alias("n"))
    bad = lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    acc = F.aggregate("xs", F.lit(0.0),
                      lambda a, e: F.when(bad(e["value"]), a + a / (e["q"] + 1).cast("double"))
                      .otherwise(a + e["value"]))
    return g.select("run", "log_window", (acc / F.col("n")).alias("loss"))


def train_summary(log: DataFrame, batch_size: int = 64) -> DataFrame:
    """Train loss = total / global step; samples and steps per second over the log span."""
    # exact decimal sum: the total does not depend on the order rows arrive in
    t = log.groupBy("run").agg(
        F.sum(F.col("value").cast("decimal(38,10)")).cast("double").alias("tot"), F.max("step").alias("steps"),
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp")))
         / F.lit(1e6)).alias("runtime"))
    rt = F.col("runtime")
    return t.select("run", (F.col("tot") / F.col("steps")).alias("train_loss"), "steps", "runtime",
                    F.when(rt > 0, F.col("steps") * batch_size / rt).alias("samples_per_second"),
                    F.when(rt > 0, F.col("steps") / rt).alias("steps_per_second"))


def eval_schedule(log: DataFrame, eval_steps: float) -> DataFrame:
    """Fractional interval -> ceil(max_steps * f); rows where step % k = 0."""
    mx = log.groupBy("run").agg(F.max("step").alias("max_steps"))
    k = (F.ceil(F.col("max_steps") * F.lit(eval_steps)) if eval_steps < 1
         else F.lit(int(eval_steps)))
    j = log.join(mx.select("run", k.cast("bigint").alias("k")), "run")
    return j.where(F.col("step") % F.col("k") == 0).drop("k")


def resume_remaining(plan: DataFrame, global_step: int, accum: int) -> DataFrame:
    """Rows not yet consumed when resuming at ``global_step``.

    plan: (id, batch) for one epoch.  steps/epoch = max(batches // accum, 1);
    skip = (global_step mod steps/epoch) * accum batches of the current epoch.
    """
    n_batches = plan.agg(F.countDistinct("batch")).scalar()
    spe = F.greatest((n_batches / accum).cast("bigint"), F.lit(1))
    skip = F.pmod(F.lit(global_step), spe) * accum
    return plan.where(F.col("batch") >= skip)

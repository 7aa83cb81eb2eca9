"""Streaming plans (ST1, ST2, U4) over documents split into files (F16)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from helixframe.operators import runs as RU
from helixframe.operators.common import r6
from helixframe.plans.q_encode import DOC_IDS, _doc_lookup
from helixframe.plans import q_logs  # noqa: F401  (the streams share its oracles)
from helixframe.plans.registry import ORACLES, query
from helixframe.plans.sqlfix import pad_sql, trunc_sql
from helixframe.sources import fixtures as FX
from helixframe.sources import io as IO
from helixframe.session import cut_lineage
from helixframe.sources.tables import table
from helixframe.streaming import run_log as RL
from helixframe.streaming import stream as STR

N_FILES = 4


@query("st1_stream_encode", f"SELECT doc_id, {pad_sql(trunc_sql('ids'))} AS input_ids FROM {DOC_IDS}")
def st1_stream_encode(spark, sf):
    p = STR.paths(IO.scratch_path(spark, "stream"))
    per = STR.split_into_files(FX.documents(spark, sf), p["src"], N_FILES)
    s = STR.encode_stream(spark, p["src"], _doc_lookup(spark, sf), files_per_trigger=per)
    STR.run_available(s, p["sink"], p["ckpt"])
    return spark.read.parquet(p["sink"]).select("doc_id", "input_ids")


@query("st2_stream_resume", "SELECT doc_id FROM documents")
def st2_stream_resume(spark, sf):
    """Two runs on one checkpoint: the second sees only the files added in between."""
    p = STR.paths(IO.scratch_path(spark, "resume"))
    docs = FX.documents(spark, sf)
    lookup = _doc_lookup(spark, sf)
    for only in ([0, 1], [2, 3]):
        per = STR.split_into_files(docs, p["src"], N_FILES, only=only)
        STR.run_available(STR.encode_stream(spark, p["src"], lookup, files_per_trigger=per), p["sink"], p["ckpt"])
    return spark.read.parquet(p["sink"]).select("doc_id")


@query("u4_eval_callback", f"""SELECT doc_id % {N_FILES} AS bucket, count(*)::DOUBLE AS value, round(avg(len({trunc_sql('ids')})), 6) + 0.0 AS mean_len
FROM {DOC_IDS} GROUP BY 1""")
def u4_eval_callback(spark, sf):
    """foreachBatch callback that appends one metric record for each file bucket of its micro-batch."""
    p = STR.paths(IO.scratch_path(spark, "callback"))
    per = STR.split_into_files(FX.documents(spark, sf), p["src"], N_FILES)
    hist = p["sink"]

    def on_evaluate(batch_df, batch_id):
        m = batch_df.groupBy(F.pmod("doc_id", F.lit(N_FILES)).alias("bucket")).agg(
            F.count(F.lit(1)).cast("double").alias("value"), F.avg(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("mean_len"))
        m.withColumn("step", F.lit(batch_id).cast("bigint")).write.mode("append").json(hist)

    STR.run_with_callback(STR.encode_stream(spark, p["src"], _doc_lookup(spark, sf), files_per_trigger=per), on_evaluate, p["cb_ckpt"])
    records = spark.read.schema("step BIGINT, bucket BIGINT, value DOUBLE, mean_len DOUBLE").json(hist)
    # a bucket of several files may come in several micro-batches
    total = records.groupBy("bucket").agg(F.sum("value").alias("value"), (F.sum(F.col("mean_len") * F.col("value")) / F.sum("value")).alias("mean_len"))
    return total.select("bucket", "value", r6("mean_len").alias("mean_len"))


LOG_FILES = 4


def _followed(spark, sf):
    """The whole event log as a stream: lands in time order with rows up to three days out of place, is stopped half way and resumed, and
    ends with a heartbeat that closes the runs."""
    root = IO.scratch_path(spark, "runlog")
    src, sink, ckpt = f"{root}/src", f"{root}/sink", f"{root}/ckpt"
    log = RU.metric_log(table(spark, sf, "events")).select(
        "run", "step", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value",
        F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("loss"))
    lo, hi = log.agg(F.min("ts"), F.max("ts")).first()
    days = (hi - lo).days + 3
    place = F.floor((F.datediff("ts", F.lit(lo)) + F.pmod(F.xxhash64("event_id"), F.lit(3))) * LOG_FILES / (days + 1))
    log = cut_lineage(log.withColumn("place", F.least(place, F.lit(LOG_FILES - 1))))
    part = log.select("run", "step", "ts", "value", "loss", "place")
    # a trigger takes one of the places whole, so their number, not the size of the log, is that of the batches that go over all runs
    files = max(1, -(-log.groupBy("place").count().agg(F.max("count")).first()[0] // RL.FILE_ROWS))
    half = LOG_FILES // 2
    for only, last in ((range(half), False), (range(half, LOG_FILES), True)):
        RL.land(part, src, F.col("place"), list(only), files)
        if last:
            RL.heartbeat(spark, src, hi + datetime.timedelta(days=30))
        RL.run_available(RL.read_log(spark, src, files_per_trigger=files), sink, ckpt)
    return spark.read.schema(RL.OUT_SCHEMA).parquet(sink)


@query("x6_loss_stream", ORACLES["x6_loss_repair"])
def x6_loss_stream(spark, sf):
    return _followed(spark, sf).where("kind = 'window'").select("run", "log_window", r6("value").alias("loss"))


@query("x2_best_stream", ORACLES["x2_best_so_far"])
def x2_best_stream(spark, sf):
    return _followed(spark, sf).where("kind = 'best'").select("run", "step", "value")

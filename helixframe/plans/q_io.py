"""Scan and sink plans (S1-S11): each writes a table derived from the inputs
to a fresh folder under the shared checkpoint folder and reads it back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from helixframe.functions import vectors as V
from helixframe.functions.hashing import acgt_string
from helixframe.operators import encode as EN
from helixframe.operators import runs as RU
from helixframe.operators.indexing import dense_index
from helixframe.plans.q_encode import DOC_IDS, _doc_ids
from helixframe.plans.registry import query
from helixframe.plans.sqlfix import EMB, PRED_EXPR, acgt, trunc_sql
from helixframe.sources import fixtures as FX
from helixframe.sources import io as IO
from helixframe.sources import npz as NPZ
from helixframe.sources.tables import table


@query("s1_corpus_scan", """
SELECT f.format, doc_id, text FROM documents, (VALUES ('csv'), ('tsv'), ('json')) f(format)""")
def s1_corpus_scan(spark, sf):
    d = FX.documents(spark, sf).select("doc_id", "text")
    root = IO.scratch_path(spark, "corpus")
    out = None
    for fmt, name in (("csv", "docs.csv"), ("tsv", "docs_tsv.csv"), ("json", "docs.json")):
        p = os.path.join(root, name)
        IO.write_corpus(d, p)
        r = IO.read_corpus(spark, p, "doc_id BIGINT, text STRING").select(
            F.lit(fmt).alias("format"), "doc_id", "text")
        out = r if out is None else out.unionByName(r)
    return out


@query("s1_text_lines", """
SELECT count(*) AS n_lines FROM (SELECT unnest(string_split(text, chr(10))) FROM documents)""")
def s1_text_lines(spark, sf):
    """txt corpus: one row per line."""
    d = FX.documents(spark, sf).select("text")
    p = os.path.join(IO.scratch_path(spark, "corpus"), "docs.txt")
    IO.write_corpus(d, p)
    return IO.read_corpus(spark, p).agg(F.count(F.lit(1)).alias("n_lines"))


@query("s2_labelled_scan", f"""
SELECT {acgt('d.doc_id')} AS dna_barcode, l.quality::BIGINT AS labels
FROM documents d JOIN labels l USING (doc_id)""")
def s2_labelled_scan(spark, sf):
    d = FX.documents(spark, sf).select("doc_id", "lang")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    csv = d.join(lab, "doc_id").select(
        acgt_string(F.col("doc_id")).alias("dna_barcode"),
        (F.col("quality").cast("double") + F.lit(0.25)).cast("string").alias("labels"),  # '1.25' -> 1
        F.col("lang").alias("note"))
    p = os.path.join(IO.scratch_path(spark, "eval"), "eval.csv")
    csv.write.mode("overwrite").option("header", True).csv(p)
    return IO.read_labelled(spark, p)


def _emb_sink(spark, sf):
    e = FX.embedding_set(spark, sf)
    rows = e.select(F.col("vec_id").alias("sample_id"), "embedding", F.col("label").cast("bigint").alias("label"),
                    F.when(F.col("vec_id") % 3 == 0, "train").when(F.col("vec_id") % 3 == 1, "val")
                    .otherwise("test").alias("partition"),
                    F.lit("dna").alias("modality"), F.lit("r1").alias("run"))
    root = IO.scratch_path(spark, "embeddings")
    IO.write_embeddings(rows, root)
    return root


_EMB_SQL = f"""SELECT vec_id AS sample_id, label::BIGINT AS label,
  CASE vec_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS partition,
  list_transform(embedding, lambda v: round(v, 6) + 0.0) AS embedding FROM ({EMB})"""


@query("s3_embedding_sink", f"SELECT sample_id, label, partition, 'dna' AS modality, embedding FROM ({_EMB_SQL})")
def s3_embedding_sink(spark, sf):
    r = IO.read_embeddings(spark, _emb_sink(spark, sf))
    return r.select("sample_id", "label", "partition", "modality", V.round_vec("embedding").alias("embedding"))


@query("s4_embedding_source", f"SELECT sample_id, label, embedding FROM ({_EMB_SQL}) WHERE partition = 'test'")
def s4_embedding_source(spark, sf):
    r = IO.read_embeddings(spark, _emb_sink(spark, sf), partitions=["test"], modalities=["dna"])
    return r.select("sample_id", "label", V.round_vec("embedding").alias("embedding"))


@query("s5_prediction_sink", f"""
SELECT vec_id AS sample_id, {PRED_EXPR} AS cluster, 'test' AS partition FROM embeddings""")
def s5_prediction_sink(spark, sf):
    p = FX.predictions(spark, sf).select(
        F.col("vec_id").alias("sample_id"), "cluster", F.lit("test").alias("partition"),
        F.lit("embeddings").alias("dataset"), F.lit("ward").alias("model"),
        F.lit("20240101-000000").alias("run_time"))
    root = IO.scratch_path(spark, "predictions")
    IO.write_predictions(p, root)
    r = spark.read.parquet(root).where("partition = 'test' AND model = 'ward'")
    return r.select("sample_id", "cluster", "partition")


LOG_SQL = """SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
  event_type AS metric, value FROM events"""


def _history(spark, sf):
    rec = RU.prefix_metric(RU.metric_log(table(spark, sf, "events"))).select("run", "step", "metric", "value")
    path = IO.scratch_path(spark, "history")
    IO.append_metrics(rec.where("step <= 40"), path)   # first evaluation round
    IO.append_metrics(rec.where("step > 40"), path)    # appended later
    # a torn line: the record of the first event, cut in the middle
    torn = rec.where("run = 0 and step = 1").select(F.concat(F.lit('{"run":'), F.col("run").cast("string"), F.lit(',"step":'), F.col("step").cast("string")).alias("value"))
    torn.write.mode("append").text(os.path.join(path, "corrupt"))
    return IO.read_metrics(spark, os.path.join(path, "*"))


@query("s6_metric_history", f"SELECT run, step, 'eval_' || metric AS metric, value FROM ({LOG_SQL})")
def s6_metric_history(spark, sf):
    return _history(spark, sf)[0]


@query("s6_quarantine", f"""SELECT '{{"run":' || run || ',"step":' || step AS line FROM ({LOG_SQL}) WHERE run = 0 AND step = 1""")
def s6_quarantine(spark, sf):
    return _history(spark, sf)[1]


@query("s7_sorted_report", """
SELECT key || ' = ' || printf('%.6f', value) AS line FROM (
  SELECT 'run' || user_id || '.' || event_type AS key, sum(value::DECIMAL(38,10))::DOUBLE / count(*) AS value
  FROM events GROUP BY user_id, event_type)""")
def s7_sorted_report(spark, sf):
    e = table(spark, sf, "events")
    # exact decimal sum, so the printed mean does not depend on summation order
    kv = e.groupBy("user_id", "event_type").agg(
        (F.sum(F.col("value").cast("decimal(38,10)")).cast("double") / F.count(F.lit(1))).alias("value")).select(
        F.concat(F.lit("run"), F.col("user_id").cast("string"), F.lit("."), F.col("event_type")).alias("key"), "value")
    path = IO.scratch_path(spark, "report")
    IO.kv_lines(kv).write.mode("overwrite").text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("s8_length_log", f"""
SELECT 'Batch item ' || (idx % 64) || ', sequence ' || v.view || ', length: ' || len AS line
FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) AS idx, len({trunc_sql('ids')}) AS len FROM {DOC_IDS}),
     (VALUES (0), (1)) v(view)""")
def s8_length_log(spark, sf):
    d = _doc_ids(spark, sf, head=126).select("doc_id", F.size(EN.truncate(F.col("ids"))).alias("len"))
    d = dense_index(d, ["doc_id"])
    lines = d.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("view"), "idx", "len").select(
        F.format_string("Batch item %d, sequence %d, length: %d", F.col("idx") % 64, F.col("view"),
                        F.col("len")).alias("line"))
    path = IO.scratch_path(spark, "seqlen")
    lines.write.mode("append").text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("s9_trial_sink", """
SELECT user_id AS trial, max(value) AS value, CASE WHEN user_id % 2 = 0 THEN 'COMPLETE' ELSE 'PRUNED' END AS state,
       round(sum(value::DECIMAL(38,10))::DOUBLE / count(*), 6) + 0.0 AS param_mean_value
FROM events GROUP BY user_id""")
def s9_trial_sink(spark, sf):
    e = table(spark, sf, "events")
    t = e.groupBy(F.col("user_id").alias("trial")).agg(
        F.max("value").alias("value"),
        F.create_map(F.lit("mean_value"), F.round(
            F.sum(F.col("value").cast("decimal(38,10)")).cast("double") / F.count(F.lit(1)), 6)).alias("params")).withColumn(
        "state", F.when(F.col("trial") % 2 == 0, "COMPLETE").otherwise("PRUNED"))
    path = IO.scratch_path(spark, "trials")
    t.select(F.to_json(F.struct("trial", "params", "value", "state")).alias("value")).write.mode("overwrite").text(path)
    r = spark.read.schema("trial BIGINT, params MAP<STRING, DOUBLE>, value DOUBLE, state STRING").json(path)
    return r.select("trial", "value", "state", (F.col("params")["mean_value"] + F.lit(0.0)).alias("param_mean_value"))


@query("s10_sanitize_filename", """
SELECT page_id, regexp_replace(replace(regexp_replace(regexp_replace(url, '[^\\x00-\\x7F]', '', 'g'),
       '^[ .]+|[ .]+$', '', 'g'), '/', '-'), '[/:*?"<>|]+', '', 'g') AS name FROM pages""")
def s10_sanitize_filename(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", IO.sanitize_filename(F.col("url")).alias("name"))


@query("s11_output_guard", "SELECT count(*) AS rows, TRUE AS second_write_refused FROM embeddings")
def s11_output_guard(spark, sf):
    """Writes once, refuses a second write without overwrite, then overwrites."""
    e = FX.embedding_set(spark, sf).select("vec_id", "label")
    path = IO.scratch_path(spark, "guard")
    IO.guarded_write(e, path)
    refused = False
    try:
        IO.guarded_write(e, path)
    except Exception:  # noqa: BLE001 - Spark raises an AnalysisException
        refused = True
    IO.guarded_write(e, path, overwrite=True)
    r = spark.read.parquet(path)
    return r.agg(F.count(F.lit(1)).alias("rows")).withColumn("second_write_refused", F.lit(refused))


# ---------------------------------------------------------------- npz files
def _npz(spark, df, name: str, max_rows: int = 4096) -> str:
    p = IO.scratch_path(spark, name)
    NPZ.write_npz(df, p, max_rows=max_rows)
    return p


@query("s3_npz_sink", "SELECT label AS y_true, count(*) AS n FROM embeddings GROUP BY label")
def s3_npz_sink(spark, sf):
    """Embedding files (embeddings, y_true); read back by label alone, so the vectors stay unread."""
    e = FX.embedding_set(spark, sf).select(F.col("embedding").alias("embeddings"), F.col("label").alias("y_true"))
    back = NPZ.read_npz(spark, _npz(spark, e, "npz-sink"), ["y_true"])
    return back.groupBy("y_true").agg(F.count(F.lit(1)).alias("n"))


@query("s4_npz_source", f"SELECT vec_id, embedding AS embeddings, label AS y_true FROM ({EMB})")
def s4_npz_source(spark, sf):
    e = FX.embedding_set(spark, sf).select("vec_id", F.col("embedding").alias("embeddings"), F.col("label").alias("y_true"))
    return NPZ.read_npz(spark, _npz(spark, e, "npz-source", 256)).select("vec_id", "embeddings", "y_true")


@query("s5_npz_predictions", f"SELECT vec_id, {PRED_EXPR} AS y_pred FROM embeddings")
def s5_npz_predictions(spark, sf):
    """Prediction files (y_pred), -1 for unclustered rows."""
    pred = FX.predictions(spark, sf).select("vec_id", F.col("cluster").alias("y_pred"))
    return NPZ.read_npz(spark, _npz(spark, pred, "npz-pred"), ["vec_id", "y_pred"])

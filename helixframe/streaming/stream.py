"""Structured Streaming twins of the batch operators (ST1, ST2, U4).

The stream reads new sequence files as they land, applies the *same* column
functions as the batch encoder (stateless, so no state store is needed) and
appends to a Parquet sink.  Exactly-once progress lives in the checkpoint
location: a restarted query skips the files it already committed (ST2).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import encode as EN

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def encode_stream(spark: SparkSession, src: str, lookup: EN.Lookup, schema: str = DOC_SCHEMA,
                  files_per_trigger: int = 1) -> DataFrame:
    """ST1: file stream -> T1-T3 (same functions as the batch path)."""
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src))
    return EN.encode(s.select("doc_id", "text"), "text", lookup).select("doc_id", "input_ids",
                                                                         "attention_mask")


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> int:
    """Process everything available now, append to ``sink``; returns the batches run."""
    q = (stream.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(q.recentProgress)


def run_with_callback(stream: DataFrame, callback, checkpoint: str) -> None:
    """U4: call ``callback(batch_df, batch_id)`` for every micro-batch (foreachBatch)."""
    q = (stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


FILE_ROWS = 50_000  # rows of one file, about


def split_into_files(df: DataFrame, dest: str, n_files: int, key: str = "doc_id",
                     only: list[int] | None = None, file_rows: int = FILE_ROWS) -> int:
    """F16: write the rows as ``n_files`` buckets (bucket = key mod n), optionally only some of them.

    A bucket is one file as long as it has ``file_rows`` rows at most, else as many as it needs, so that no task writes or reads
    a fixed share of the table.  Returns the files of a bucket: what a trigger has to take to keep ``n_files`` batches."""
    per = max(1, -(-df.count() // (n_files * file_rows)))
    b = df.withColumn("_bucket", F.pmod(F.col(key), F.lit(n_files)))
    if only is not None:
        b = b.where(F.col("_bucket").isin(only))
    if per == 1:
        b = b.repartition(n_files, "_bucket")
    else:
        part = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(per))
        b = b.repartitionById(n_files * per, (F.coalesce("_bucket", F.lit(0)) * per + part).cast("int"))
    b.drop("_bucket").write.mode("append").parquet(dest)
    return per


def paths(root: str) -> dict[str, str]:
    return {k: os.path.join(root, k) for k in ("src", "sink", "ckpt", "cb_ckpt")}

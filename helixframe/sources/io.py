"""Scans and sinks.

Every sink goes through Spark's file commit protocol: files appear only when
the job commits, which replaces the temp-file-then-rename publish of a
single-process writer.  Paths live under the shared checkpoint folder (or a
folder the caller passes), never a machine-local temp folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.session import checkpoint_dir

CORPUS_FORMATS = ("csv", "json", "txt")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex[:12]}")


def corpus_format(path: str) -> tuple[str, str | None]:
    """S1 rule: format = text after the last dot; tab delimiter when the path contains 'tsv'."""
    ext = path.rsplit(".", 1)[-1] if "." in os.path.basename(path.rstrip("/")) else ""
    if ext not in CORPUS_FORMATS:
        raise ValueError(f"corpus file must be csv, json or txt, got {ext!r}")
    sep = "\t" if (ext == "csv" and "tsv" in path) else ("," if ext == "csv" else None)
    return ext, sep


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Csv / tsv / json / txt corpus; txt gives one row per line (column `text`)."""
    fmt, sep = corpus_format(path)
    if fmt == "txt":
        return spark.read.text(path).withColumnRenamed("value", "text")
    if fmt == "json":
        r = spark.read
        return (r.schema(schema) if schema else r).json(path)
    r = (spark.read.option("header", True).option("sep", sep).option("multiLine", True)
         .option("escape", '"'))
    return (r.schema(schema) if schema else r).csv(path)


def write_corpus(df: DataFrame, path: str) -> None:
    fmt, sep = corpus_format(path)
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "txt":
        df.select(F.col(df.columns[-1]).alias("value")).write.mode("overwrite").text(path)
    else:
        (df.write.mode("overwrite").option("header", True).option("sep", sep)
         .option("escape", '"').csv(path))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Only (dna_barcode, labels); labels number -> double -> bigint (truncates)."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return r.select("dna_barcode", F.col("labels").cast("double").cast("bigint").alias("labels"))


def write_embeddings(df: DataFrame, root: str, mode: str = "append") -> None:
    """S3: (sample_id, embedding, label, partition, modality, run) partitioned Parquet."""
    df.write.mode(mode).partitionBy("partition", "modality", "run").parquet(root)


def read_embeddings(spark: SparkSession, root: str, partitions=None, modalities=None,
                    runs=None) -> DataFrame:
    """Partition filters prune directories before any file is opened."""
    df = spark.read.parquet(root)
    if partitions:
        df = df.where(F.col("partition").isin(list(partitions)))
    if modalities:
        df = df.where(F.col("modality").isin(list(modalities)))
    if runs:
        df = df.where(F.col("run").isin(list(runs)))
    return df


def write_predictions(df: DataFrame, root: str) -> None:
    """(sample_id, cluster) partitioned by partition / dataset / model / run_time."""
    df.write.mode("append").partitionBy("partition", "dataset", "model", "run_time").parquet(root)


METRIC_SCHEMA = "run BIGINT, step BIGINT, metric STRING, value DOUBLE, _corrupt STRING"


def append_metrics(df: DataFrame, path: str) -> None:
    """One JSON record per metric row, appended (never rewritten)."""
    df.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S6 read side: (good rows, quarantined lines) - a bad line never drops the history."""
    parsed = spark.read.text(path).select(F.col("value").alias("line"), F.from_json(
        "value", METRIC_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull()
    return parsed.where(~bad).select("r.run", "r.step", "r.metric", "r.value"), parsed.where(bad).select("line")


def kv_lines(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """S7: 'key = value' lines (value as %.6f) sorted by key."""
    return df.orderBy(key).select(
        F.concat_ws(" = ", F.col(key), F.format_string("%.6f", F.col(value))).alias("line"))


def sanitize_filename(c: Column, allow_dotfiles: bool = False) -> Column:
    """Drop non-ASCII; strip spaces/dots (or whitespace + trailing dots);
    '/' -> '-'; delete the characters / : * ? " < > |."""
    t = F.regexp_replace(c, "[^\\x00-\\x7F]", "")
    if allow_dotfiles:
        t = F.regexp_replace(F.regexp_replace(t, "^[ \\t\\n\\r\\x0B\\f\\x1C-\\x1F]+|[ \\t\\n\\r\\x0B\\f\\x1C-\\x1F]+$", ""),
                             "\\.+$", "")
    else:
        t = F.regexp_replace(t, "^[ .]+|[ .]+$", "")
    t = F.regexp_replace(t, "/", "-")
    return F.regexp_replace(t, "[/:*?\"<>|]+", "")


def guarded_write(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Refuse a non-empty output folder unless overwrite is asked."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)

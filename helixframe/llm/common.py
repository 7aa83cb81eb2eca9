"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of at most ``rows`` rows in this session: rows here are whole texts, and the default of 10,000 holds tens of MB on both sides."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that outlives any executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_of(c: str | Column) -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batch: pa.RecordBatch, rows: int = 256):
    """Slices of an Arrow batch, so that what Python holds at a time stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tidy() -> None:
    """Hands freed memory back to the system at the end of a task: a Python worker is reused and idles with what it holds."""
    import ctypes
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def components(nodes_pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable over the pairs; nodes of the pairs only.

    Large-star/small-star rounds: every round is two shuffles of at most as many
    edges as before, and the number of rounds follows the logarithm of the longest
    path.  The edges of each round are staged in the shared folder.  Nothing but
    two counts reaches the driver.  A hub's edges are aggregated by ``min`` (which
    combines before the shuffle) and joined back, so no group is collected.
    """
    edges = staged(nodes_pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
                   .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = joined.select(F.col("a"), F.col("m").alias("b")).unionAll(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = staged(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)

"""Ragged (unpadded) token blocks: pack, unpack, gather, scatter.

The long table ``(batch, seq, pos, value)`` stores only real tokens, so the
padding never travels through a shuffle.  Offsets are prefix sums over a
batch (bounded by the batch size); re-padding is a dense grid left-joined on
the flat index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pack(padded: DataFrame, key: str, batch: str, seq: str, ids: str = "input_ids",
         mask: str = "attention_mask") -> DataFrame:
    """Per sequence: seqlen, cu_start (prefix sum with a leading 0) and the batch max."""
    s = padded.select(key, batch, seq, F.aggregate(mask, F.lit(0), lambda a, m: a + m).alias("seqlen"))
    w = Window.partitionBy(batch).orderBy(seq)
    return s.select(key, batch, seq, "seqlen",
                    F.coalesce(F.sum("seqlen").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                               F.lit(0)).cast("bigint").alias("cu_start"),
                    F.max("seqlen").over(Window.partitionBy(batch)).alias("max_seqlen"))


def unpad(padded: DataFrame, key: str, seq: str, max_len: int, ids: str = "input_ids",
          mask: str = "attention_mask") -> DataFrame:
    """(key, flat index = seq * L + pos, value) for mask = 1 positions."""
    z = padded.select(key, seq, F.posexplode(F.arrays_zip(F.col(ids).alias("v"), F.col(mask).alias("m")))
                      .alias("pos", "z"))
    return z.where(F.col("z.m") == 1).select(
        key, (F.col(seq) * max_len + F.col("pos")).cast("bigint").alias("flat"), F.col("z.v").alias("value"))


def repad(packed: DataFrame, keys: DataFrame, key: str, seq: str, max_len: int) -> DataFrame:
    """Scatter packed rows into a zero grid (one row of L cells per sequence)."""
    grid = keys.select(key, seq, F.explode(F.sequence(F.lit(0), F.lit(max_len - 1))).alias("pos"))
    grid = grid.withColumn("flat", (F.col(seq) * max_len + F.col("pos")).cast("bigint"))
    j = grid.join(packed.select(key, "flat", "value"), [key, "flat"], "left")
    cells = j.select(key, "pos", F.coalesce("value", F.lit(0)).alias("value"))
    return (cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_a"))
            .select(key, F.col("_a.value").alias("input_ids")))


def gather(rows: DataFrame, index: DataFrame, row_key: str, idx_col: str, pos_col: str) -> DataFrame:
    """Rows at ``idx`` in ``pos`` order, repeats kept (an equi-join on the index)."""
    return index.join(rows, index[idx_col] == rows[row_key]).drop(idx_col)


def scatter(values: DataFrame, n: int, idx_col: str, pos_col: str, value_col: str) -> DataFrame:
    """zeros(n) with out[idx] = value; on repeated idx the highest position wins."""
    spark = values.sparkSession
    w = values.groupBy(idx_col).agg(F.max_by(value_col, pos_col).alias("value"))
    grid = spark.range(n).select(F.col("id").alias("row"))
    return grid.join(w, grid["row"] == w[idx_col], "left").select(
        "row", F.coalesce("value", F.lit(0)).alias("value"))

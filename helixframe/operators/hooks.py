"""User hooks over the rows: batched preparation (U2) and a collate function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.indexing import dense_index


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on each Arrow batch; its columns replace those of ``df``.  Empty batches are skipped."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield fn(pdf)
    return df.mapInPandas(run, schema)


def collate_batches(df: DataFrame, order_cols: list[str], batch_size: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` once per batch of ``batch_size`` rows (in ``order_cols`` order), its rows tagged with the batch."""
    d = dense_index(df, order_cols).withColumn("batch", (F.col("idx") / batch_size).cast("bigint")).drop("idx")

    def run(key, pdf):
        out = fn(pdf.drop(columns="batch").sort_values(order_cols, ignore_index=True))
        out.insert(0, "batch", key[0])
        return out
    return d.groupBy("batch").applyInPandas(run, f"batch bigint, {schema}")

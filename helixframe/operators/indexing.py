"""Skew-proof ordered indexing and running aggregates.

A window ``PARTITION BY g ORDER BY o`` sends a whole group to one task; with
one group holding a third of the rows that task holds a third of the data.
These helpers range-partition on (g, o) instead, so a hot group is split
across many tasks, and stitch the pieces with a tiny per-(partition, group)
offset table:

1. ``repartitionByRange(P, g, o)`` + ``sortWithinPartitions``: the order
   columns must form a total order (add a unique tie-breaker).
2. Per (partition, group): row count / aggregate of the piece (small table).
3. Exclusive prefix of the pieces over the partition index, per group.
4. Rows = piece offset combined with the in-piece value.

Everything is deterministic for a given input: the range bounds are
computed once per exchange and the in-partition order is a total order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.session import cut_lineage


def _parts(df: DataFrame, n_parts: int | None) -> int:
    if n_parts:
        return n_parts
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def dense_index(df: DataFrame, order_cols: list[str], group_cols: list[str] | None = None,
                name: str = "idx", n_parts: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order (within ``group_cols``)."""
    g = list(group_cols or [])
    cols = g + list(order_cols)
    r = (df.repartitionByRange(_parts(df, n_parts), *cols).sortWithinPartitions(*cols)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    # The ids must be read identically by the piece table and the rows: cut the
    # lineage with a reliable checkpoint (shared folder) so both see one copy.
    r = cut_lineage(r)
    pieces = r.groupBy("_pid", *g).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = pieces.select("_pid", *g, "_m0",
                         F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    return (r.join(offs, ["_pid", *g])
            .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("bigint"))
            .drop("_pid", "_mid", "_m0", "_off"))


_NP = {"sum": np.cumsum, "max": np.maximum.accumulate, "min": np.minimum.accumulate}
_SQL = {"sum": F.sum, "max": F.max, "min": F.min}


def running_agg(df: DataFrame, value, order_cols: list[str], group_cols: list[str],
                op: str = "max", name=None, exclusive: bool = False,
                n_parts: int | None = None) -> DataFrame:
    """Running sum/max/min of one or more value columns per group, in order.

    ``value``/``name`` may be a column name or a list of them.  ``exclusive``
    gives the aggregate of the rows strictly before (null for the first row
    of a group), i.e. ``ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING``.
    Values must be non-null and not NaN.  The in-piece scan runs in pandas
    inside each task; a piece is one (partition, Arrow batch, group) run, and
    pieces are stitched by a prefix over the small piece table.  No group is
    gathered into one task.
    """
    values = [value] if isinstance(value, str) else list(value)
    names = ([name or "running"] if isinstance(value, str) else list(name or [v + "_run" for v in values]))
    g = list(group_cols)
    cols = g + list(order_cols)
    r = (df.repartitionByRange(_parts(df, n_parts), *cols).sortWithinPartitions(*cols)
         .withColumn("_pid", F.spark_partition_id()))
    extra = [T.StructField("_chunk", T.LongType())]
    for k in range(len(values)):
        extra += [T.StructField(f"_loc{k}", T.DoubleType()), T.StructField(f"_locx{k}", T.DoubleType())]
    schema = T.StructType(r.schema.fields + extra)
    fn = _NP[op]

    def scan(batches):
        for chunk, pdf in enumerate(batches):
            if len(pdf) == 0:
                continue
            if g:
                starts = np.r_[True, np.zeros(len(pdf) - 1, dtype=bool)]
                for c in g:  # a run starts where any key column changes (null equals null)
                    k = pdf[c].to_numpy(dtype=object)
                    starts[1:] |= (k[1:] != k[:-1]) & ~(pd.isna(k[1:]) & pd.isna(k[:-1]))
            else:
                starts = np.r_[True, np.zeros(len(pdf) - 1, dtype=bool)]
            bounds = np.r_[np.flatnonzero(starts), len(pdf)]
            cols_out = {"_chunk": chunk}
            for k, v in enumerate(values):
                x = pdf[v].astype("float64").to_numpy()
                loc = np.empty_like(x)
                for a, b in zip(bounds[:-1], bounds[1:]):
                    loc[a:b] = fn(x[a:b])
                locx = np.r_[np.nan, loc[:-1]]
                locx[starts] = np.nan
                cols_out[f"_loc{k}"] = loc
                cols_out[f"_locx{k}"] = locx
            yield pdf.assign(**cols_out)

    local = cut_lineage(r.mapInPandas(scan, schema))  # rows and pieces must come from one and the same exchange
    pieces = local.groupBy("_pid", "_chunk", *g).agg(
        *[_SQL[op](v).alias(f"_tot{k}") for k, v in enumerate(values)])
    w = Window.partitionBy(*g).orderBy("_pid", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = pieces.select("_pid", "_chunk", *g,
                         *[_SQL[op](f"_tot{k}").over(w).alias(f"_before{k}") for k in range(len(values))])
    j = local.join(offs, ["_pid", "_chunk", *g])
    comb = {"sum": lambda a, b: F.coalesce(a, F.lit(0.0)) + b,
            "max": lambda a, b: F.coalesce(F.greatest(a, b), b),
            "min": lambda a, b: F.coalesce(F.least(a, b), b)}[op]
    outs = []
    for k, nm in enumerate(names):
        before = F.col(f"_before{k}")
        if not exclusive:
            out = comb(before, F.col(f"_loc{k}"))
        else:
            locx = F.when(F.isnan(f"_locx{k}"), F.lit(None)).otherwise(F.col(f"_locx{k}"))
            out = F.when(locx.isNull(), before).otherwise(comb(before, locx))
        outs.append(out.alias(nm))
    keep = [c for c in df.columns]
    return j.select(*keep, *outs)

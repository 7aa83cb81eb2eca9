"""Blocked all-pairs join: the shared primitive behind every O(n^2) metric.

Rows get a block ``b = pmod(xxhash64(id), B)``.  A left copy of each row is
emitted for partner blocks ``b..B-1`` and a right copy for ``0..b``; an
equi-join on the (lower block, upper block) key then produces every
unordered pair exactly once (ids compared only inside one block).  Each join
key holds about n/B x n/B pairs, so task memory stays bounded as n grows.
Both sides are hash-partitioned explicitly with one partition per block pair,
so AQE does not coalesce the (small but pair-expanding) shuffle into a single task.

``block_sweep`` does the same for whole tables without the B copies of each
row: a block is packed into one row, written once, and Spark's cartesian
product of the blocks reads the stored blocks for each pair.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.session import cut_lineage


def n_blocks(n: int, block_rows: int) -> int:
    return max(1, math.ceil(n / max(1, block_rows)))


def block_pairs(df: DataFrame, id_col: str, cols: list[str], block_rows: int = 256,
                n: int | None = None, directed: bool = False,
                include_self: bool = False, keep_keys: bool = False,
                group: str | None = None) -> DataFrame:
    """Pairs of rows of ``df`` as columns ``l_id, l_<c>..., r_id, r_<c>...``.

    ``id_col`` must be unique (within ``group`` when given: pairs are then
    formed inside each group only, the group being part of the join key).
    Undirected by default (each unordered pair once); ``directed`` adds the
    mirrored rows; ``include_self`` adds (i, i).
    """
    if n is None:
        n = df.count()  # a scalar: the rows stay on the executors
    B = n_blocks(n, block_rows)
    fields = ["id"] + list(cols)
    gk = ["_g"] if group else []
    base = df.select(F.col(id_col).alias("id"), *[F.col(c) for c in cols],
                     *([F.col(group).alias("_g")] if group else [])).withColumn(
        "_b", F.pmod(F.xxhash64("id"), F.lit(B)).cast("int"))
    parts = B * (B + 1) // 2  # one task for each block pair, however many there are
    left = base.select(*[F.col(c).alias("l_" + c) for c in fields], *gk,
                       F.col("_b").alias("_k1"),
                       F.explode(F.sequence(F.col("_b"), F.lit(B - 1))).alias("_k2"))
    right = base.select(*[F.col(c).alias("r_" + c) for c in fields], *gk,
                        F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_k1"),
                        F.col("_b").alias("_k2"))
    left = left.repartition(parts, *gk, "_k1", "_k2")
    right = right.repartition(parts, *gk, "_k1", "_k2")
    j = (left.join(right, gk + ["_k1", "_k2"])
         .where((F.col("_k1") != F.col("_k2")) | (F.col("l_id") < F.col("r_id"))))
    if keep_keys:
        return j
    j = j.drop("_k1", "_k2")
    out = j
    if directed:
        swap = j.select(*gk, *[F.col("r_" + c).alias("l_" + c) for c in fields],
                        *[F.col("l_" + c).alias("r_" + c) for c in fields])
        out = out.unionByName(swap)
    if include_self:
        diag = base.select(*gk, *[F.col(c).alias("l_" + c) for c in fields],
                           *[F.col(c).alias("r_" + c) for c in fields])
        out = out.unionByName(diag)
    return out


def block_apply(df: DataFrame, id_col: str, cols: list[str], fn, schema, block_rows: int = 256,
                n: int | None = None, group: str | None = None) -> DataFrame:
    """Run ``fn(left, right, same_block)`` on every block pair with numpy.

    Rows are replicated to their block pairs exactly as in ``block_pairs``;
    each (lower, upper) block pair becomes one pandas group of about
    2 * block_rows rows (a bound set by ``block_rows``, not by the data), and
    ``fn`` returns partial results (for example sums or per-row partials)
    that Spark aggregates afterwards.  When ``same_block`` is true, left and
    right are the same rows and ``fn`` must use each unordered pair once.
    """
    if n is None:
        n = df.count()
    B = n_blocks(n, block_rows)
    gk = [group] if group else []
    base = df.select(F.col(id_col).alias("id"), *gk, *[F.col(c) for c in cols]).withColumn(
        "_b", F.pmod(F.xxhash64("id"), F.lit(B)).cast("int"))
    left = base.select("id", *gk, *cols, F.col("_b").alias("_k1"),
                       F.explode(F.sequence(F.col("_b"), F.lit(B - 1))).alias("_k2"),
                       F.lit(0).alias("_side"))
    right = base.select("id", *gk, *cols, F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_k1"),
                        F.col("_b").alias("_k2"), F.lit(1).alias("_side"))
    both = left.unionByName(right).repartition(B * (B + 1) // 2, *gk, "_k1", "_k2")

    def run(pdf):
        same = bool(pdf["_k1"].iloc[0] == pdf["_k2"].iloc[0])
        lt = pdf[pdf["_side"] == 0].sort_values("id").reset_index(drop=True)
        rt = pdf[pdf["_side"] == 1].sort_values("id").reset_index(drop=True)
        return fn(lt, rt, same)
    return both.groupBy(*gk, "_k1", "_k2").applyInPandas(run, schema)


HELD_BLOCKS = 32  # blocks a task holds of one side at most


def packed_blocks(df: DataFrame, id_col: str, cols: list[str], block_rows: int, n: int | None = None) -> tuple[DataFrame, int]:
    """((b, rows), partitions): one row for each block of about ``block_rows`` rows, its rows by id as packed numpy arrays; checkpointed, blocks dealt evenly."""
    B = n_blocks(df.count() if n is None else n, block_rows)
    parts = min(B, max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(B / HELD_BLOCKS)))
    base = df.select(F.col(id_col).alias("id"), *cols, F.pmod(F.xxhash64(F.col(id_col)), F.lit(B)).cast("int").alias("b"))
    schema = pa.schema([("b", pa.int32()), ("rows", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        return pa.table([[t.column("b")[0].as_py()], [_packed(_columns(t, ["id", *cols]))]], schema=schema)

    blocks = base.withColumn("_p", F.col("b") % parts).repartitionById(parts, F.col("_p")).groupBy("_p", "b").applyInArrow(run, "b int, rows binary")
    return cut_lineage(blocks), parts


def _columns(rows: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    """The columns of a block by id: vectors as matrices, nulls in numbers as NaN; rows without an id come last."""
    out = {}
    for name in names:
        col = rows.column(name).combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        if pa.types.is_list(col.type):
            flat = col.flatten().to_numpy(zero_copy_only=False)
            sizes = col.value_lengths()
            if sizes.null_count or len(sizes.unique()) != 1:
                raise ValueError(f"column {name} holds null vectors or vectors of different lengths")
            out[name] = flat.reshape(len(col), -1)
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    at = np.argsort(out["id"], kind="stable")
    return {c: v[at] for c, v in out.items()}


def _packed(columns: dict[str, np.ndarray]) -> bytes:
    to = io.BytesIO()
    for v in columns.values():
        np.save(to, v, allow_pickle=False)
    return to.getvalue()


def _unpacked(block: pa.BinaryScalar, names: list[str]) -> dict[str, np.ndarray]:
    at = pa.BufferReader(block.as_buffer())
    return {c: np.load(at, allow_pickle=False) for c in names}


def block_sweep(df: DataFrame, id_col: str, cols: list[str], fn, schema: str | T.StructType, block_rows: int = 1024, n: int | None = None, directed: bool = False) -> DataFrame:
    """``fn`` over a task's stream of block pairs (l, left, r, right): block numbers and the columns of both blocks as numpy arrays.

    ``fn`` keeps its partial results over all pairs of the task and yields them as pandas frames, so what is shuffled afterwards grows with the
    tasks, not with the pairs.  Undirected, each pair l <= r comes once; when l == r both are the same rows and ``fn`` must use each
    unordered pair of rows once.  ``directed``, every (l, r) comes, and a task has the pairs of its left blocks (``HELD_BLOCKS`` at most)
    with all right blocks.  Nothing but the packed blocks is written.
    """
    blocks, parts = packed_blocks(df, id_col, cols, block_rows, n)
    left = blocks.select(F.col("b").alias("l"), F.col("rows").alias("left"))
    right = blocks.select(F.col("b").alias("r"), F.col("rows").alias("right"))
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    pairs = pairs.coalesce(parts) if directed else pairs.where("l <= r")
    out = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)
    names = ["id", *cols]

    def stream(batches):
        now, a = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                at, to = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                if at != now:  # a left block comes with several right blocks in a row
                    now, a = at, _unpacked(batch.column(1)[k], names)
                yield at, a, to, a if at == to else _unpacked(batch.column(3)[k], names)

    def run(batches):
        for pdf in fn(stream(batches)):
            yield pa.RecordBatch.from_pandas(pdf, schema=arrow, preserve_index=False)
    return pairs.mapInArrow(run, out)

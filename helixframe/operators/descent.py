"""Approximate k-nearest-neighbour graph by neighbour descent (K3 at scale).

``knn_graph`` in ``graph.py`` compares all pairs; this one looks only at neighbours of neighbours:

1. Start: rows meet in small leaves, those of a few projection trees (sign
   codes of random hyperplanes through the mean, large leaves dealt on by a
   hash) and one random partition.
2. Round: every row v gathers a bounded sample of its neighbours and of the
   rows that point to it (sampled by hash, so a hub's reverse edges are cut
   before the shuffle).  All pairs of the list with a fresh edge are compared
   in numpy inside the task, and the kernel emits only pairs that improve on
   the present k-th distance of their row.
3. Merge: the k best of old and new edges for each row; rounds end when at
   most ``share`` of the n * k edges changed.

A list or leaf holds at most about 4 * sample or 2 * leaf_rows rows whatever
the data, vectors travel O(n * sample) times a round, and no step is all
pairs.  Only counts and the d-vector of means reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.pairs import n_blocks
from helixframe.session import cut_lineage

_EDGE = "src bigint, dst bigint, dist double"
_EDGE_PA = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("dist", pa.float64())])


def _distances(A: np.ndarray, B: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise distances of two equally long stacks, by plain differences."""
    diff = A - B
    if metric in ("euclidean", "l2"):
        return np.sqrt((diff * diff).sum(-1))
    if metric == "sqeuclidean":
        return (diff * diff).sum(-1)
    if metric in ("cityblock", "l1", "manhattan"):
        return np.abs(diff).sum(-1)
    raise ValueError(metric)


def _screen(X: np.ndarray, metric: str) -> np.ndarray:
    """All distances of a list: Gram form about the list's mean for Euclidean ones (only to choose pairs, which are then measured plainly)."""
    if metric in ("cityblock", "l1", "manhattan"):
        return np.stack([np.abs(X - x).sum(-1) for x in X])
    Z = X - X.mean(0)
    q = (Z * Z).sum(1)
    D = np.maximum(q[:, None] + q[None, :] - 2.0 * (Z @ Z.T), 0.0)
    return D if metric == "sqeuclidean" else np.sqrt(D)


def _pairs_of_list(ids, fresh, bound, X, k: int, metric: str):
    """(src, dst, dist) of the pairs with a fresh member that beat the bound of their row, at most k for each row."""
    m = len(ids)
    if m < 2 or not fresh.any():
        return None
    D = _screen(X, metric)
    ok = (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :])
    # the screen's rounding must not drop a pair: a little slack, settled below
    D = np.where(ok & (D <= bound[:, None] * (1 + 1e-6) + 1e-9), D, np.inf)
    kk = min(k, m - 1)
    near = np.argpartition(D, kk - 1, axis=1)[:, :kk]
    a, b = np.repeat(np.arange(m), kk), near.ravel()
    take = np.isfinite(D[a, b])
    a, b = a[take], b[take]
    d = _distances(X[a], X[b], metric)
    take = d < bound[a]
    return ids[a[take]], ids[b[take]], d[take]


def _local_join(k: int, metric: str):
    """Kernel over rows (v, c, fresh, bound, x) sorted by v: a list is a run of one v and is handled when the next begins."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def lists(table: pa.Table, cuts):
            v = [table.column(i).to_numpy() for i in (1, 2, 3)]
            x = table.column(4).combine_chunks()
            x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
            X = x.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            out = [r for a, b in zip(cuts[:-1], cuts[1:]) if (r := _pairs_of_list(v[0][a:b], v[1][a:b], v[2][a:b], X[a:b], k, metric))]
            if out:
                yield pa.record_batch([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], schema=_EDGE_PA)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            keys = batch.column(0).to_numpy()
            changes = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if len(held) > 1 and held[-2].column(0)[-1].as_py() != keys[0]:
                changes = np.r_[0, changes]
            if not len(changes):
                continue
            before = sum(b.num_rows for b in held[:-1])
            last = int(changes[-1])
            table = pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
            held = [batch.slice(last)]
            at = table.column(0).to_numpy()
            yield from lists(table, np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, before + last])
        if held:
            table = pa.Table.from_batches(held)
            yield from lists(table, np.array([0, table.num_rows]))

    return run


def _compare(lists: DataFrame, k: int, metric: str) -> DataFrame:
    rows = lists.select("v", "c", "fresh", "bound", "x").repartition("v").sortWithinPartitions("v", "c")
    return rows.mapInArrow(_local_join(k, metric), _EDGE)


def _leaves(vecs: DataFrame, n: int, trees: int, leaf_rows: int, seed: int) -> DataFrame:
    """(v, c, fresh, bound, x): every row in one leaf of each projection tree and of a random partition."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    mean = vecs.select(Summarizer.mean(array_to_vector("x")).alias("m")).first()["m"].toArray()
    bits = max(0, min(48, int(np.log2(max(1.0, n / leaf_rows)))))
    planes = np.random.default_rng(seed).standard_normal((len(mean), trees * bits))

    def codes(batches):
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            X = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            side = ((X - mean) @ planes > 0).reshape(len(X), trees, bits)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list((side @ weights)), pa.list_(pa.int64()))], names=["c", "x", "codes"])

    coded = vecs.select("id", "x").mapInArrow(codes, "c bigint, x array<double>, codes array<bigint>") if bits else vecs.select(
        F.col("id").alias("c"), "x", F.array_repeat(F.lit(0).cast("bigint"), trees).alias("codes"))
    flat = coded.select("c", "x", F.posexplode("codes").alias("tree", "code"))
    sizes = flat.groupBy("tree", "code").agg(F.count(F.lit(1)).alias("m"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / leaf_rows))
    leaf = flat.join(sizes, ["tree", "code"]).select(
        F.xxhash64("tree", "code", F.pmod(F.xxhash64(F.lit(seed), "tree", "c"), parts)).alias("v"), "c", "x")
    chance = vecs.select(F.xxhash64(F.lit("chance"), F.pmod(F.xxhash64(F.lit(seed), F.lit("chance"), "id"), F.lit(n_blocks(n, leaf_rows)))).alias("v"),
                         F.col("id").alias("c"), "x")
    return leaf.unionByName(chance).withColumn("fresh", F.lit(True)).withColumn("bound", F.lit(float("inf")))


def _best(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, dist, fresh, added): the k best edges of each row; ``known`` marks those it had before."""
    e = edges.repartition("src").groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.max("known").alias("known"), F.max(F.when(F.col("known"), F.col("fresh"))).alias("was"))
    w = Window.partitionBy("src").orderBy("dist", "dst")
    e = e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return e.select("src", "dst", "dist", F.when(F.col("known"), F.col("was")).otherwise(F.lit(True)).alias("fresh"), (~F.col("known")).alias("added"))


def knn_descent(df: DataFrame, id_col: str, vec: str, k: int = 30, metric: str = "euclidean", trees: int = 4, leaf_rows: int = 64,
                sample: int | None = None, share: float = 0.001, seed: int = 0) -> DataFrame:
    """K3, approximate: (src, dst, rank, dist) with min(k, n - 1) neighbours a row.

    ``id_col`` is unique and not null, vectors have one length and finite components.  ``share``: rounds end when at most that
    share of the edges changed; a round only ever improves edges, so they do end.  An empty table or a single row has no edges.
    """
    vecs = cut_lineage(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("x")))
    n = vecs.count()
    if n < 2:
        return df.sparkSession.createDataFrame([], "src bigint, dst bigint, rank int, dist double")
    S = sample or max(8, 2 * k // 3)
    first = _compare(_leaves(vecs, n, trees, leaf_rows, seed), k, metric)
    graph = cut_lineage(_best(first.withColumn("known", F.lit(False)).withColumn("fresh", F.lit(True)), k))
    round_ = 0
    while True:
        round_ += 1
        draw = lambda name: F.xxhash64(F.lit(seed), F.lit(round_), F.lit(name), "src", "dst")
        drawn = graph.withColumn("_s", F.row_number().over(Window.partitionBy("src", "fresh").orderBy(draw("ahead"), "dst")) <= S)
        ahead = drawn.where("_s")
        back = ahead.withColumn("_b", F.row_number().over(Window.partitionBy("dst", "fresh").orderBy(draw("back"), "src"))).where(F.col("_b") <= S)
        lists = (ahead.select(F.col("src").alias("v"), F.col("dst").alias("c"), "fresh")
                 .unionAll(back.select(F.col("dst").alias("v"), F.col("src").alias("c"), "fresh")).groupBy("v", "c").agg(F.max("fresh").alias("fresh")))
        # a list without a fresh edge has nothing to compare: its vectors stay where they are
        lists = lists.withColumn("_any", F.max("fresh").over(Window.partitionBy("v"))).where("_any").drop("_any")
        full = graph.groupBy("src").agg(F.count(F.lit(1)).alias("m"), F.max("dist").alias("far"))
        nodes = vecs.join(full.withColumnRenamed("src", "id"), "id", "left").select(
            F.col("id").alias("c"), "x", F.when(F.col("m") >= k, F.col("far")).otherwise(F.lit(float("inf"))).alias("bound"))
        found = _compare(lists.join(nodes, "c"), k, metric).withColumn("known", F.lit(False)).withColumn("fresh", F.lit(True))
        held = drawn.select("src", "dst", "dist", F.lit(True).alias("known"), (F.col("fresh") & ~F.col("_s")).alias("fresh"))
        graph = cut_lineage(_best(held.unionByName(found), k))
        changed = graph.where("added").count()
        if changed <= share * n * k:
            break
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return graph.select("src", "dst", F.row_number().over(w).alias("rank"), "dist")


def nearest_of(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", block_rows: int = 1024) -> DataFrame:
    """Exact (src, dst, dist) of the k nearest ``base`` rows of each query row, both (id, x): query blocks meet base blocks, and a block
    pair emits k rows for each of its queries."""
    nq, nb = n_blocks(queries.count(), block_rows), n_blocks(base.count(), block_rows)
    at = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    q = queries.select("id", "x", F.lit(1).alias("asks"), at(nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("bb"))
    b = base.select("id", "x", F.lit(0).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), at(nb).alias("bb"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        Q, B = pdf[pdf["asks"] == 1], pdf[pdf["asks"] == 0].sort_values("id")
        out = []
        XB = np.vstack(B["x"].to_numpy()) if len(B) else None
        ids = B["id"].to_numpy()
        for i, x in zip(Q["id"], Q["x"]) if len(B) else ():
            d = _distances(XB, np.asarray(x)[None, :], metric)
            d[ids == i] = np.inf
            near = np.argsort(d, kind="stable")[:k]
            near = near[np.isfinite(d[near])]
            out.append(pd.DataFrame({"src": i, "dst": ids[near], "dist": d[near]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"src": np.empty(0, np.int64), "dst": np.empty(0, np.int64), "dist": np.empty(0)})

    best = q.unionByName(b).groupBy("qb", "bb").applyInPandas(run, _EDGE)
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def recall(graph: DataFrame, df: DataFrame, id_col: str, vec: str, k: int, metric: str = "euclidean", every: int = 100) -> DataFrame:
    """(n_queries, recall): share of the exact k nearest that ``graph`` holds for the rows whose id is divisible by ``every``; a neighbour as near as
    the exact k-th counts, so ties do not lower it."""
    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("x"))
    exact = nearest_of(base.where(F.col("id") % every == 0), base, k, metric).groupBy("src").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("m"))
    # the row of an id without any edge counts as missed
    hit = exact.join(graph.select("src", "dist"), "src", "left").groupBy("src", "m").agg(F.count_if(F.col("dist") <= F.col("far") * (1 + 1e-9)).alias("hits"))
    return hit.agg(F.count(F.lit(1)).alias("n_queries"), (F.sum(F.least("hits", "m")) / F.sum("m")).alias("recall"))

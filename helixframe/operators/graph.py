"""k-nearest-neighbour graph and exact silhouette (K3, K15) on blocked pairs.

Spark pairs every left block with all right blocks; the arithmetic of one
block pair (at most about 2 x block_rows rows) runs in numpy inside the task,
which hands on only what it kept over all its pairs (top-k candidates,
per-cluster distance sums).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.operators.pairs import block_sweep


_KNN_SCHEMA = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()),
                            T.StructField("dist", T.DoubleType())])


def _exact(XL: np.ndarray, XR: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs (XL[rows], XR[cols]), some thousand at a time."""
    out = np.empty(len(rows))
    for a in range(0, len(rows), 16384):
        diff = XL[rows[a:a + 16384]] - XR[cols[a:a + 16384]]
        out[a:a + 16384] = np.abs(diff).sum(-1) if metric in ("cityblock", "l1", "manhattan") else (diff * diff).sum(-1)
    return np.sqrt(out) if metric in ("euclidean", "l2") else out


def _screen(XL: np.ndarray, XR: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """A quick matrix that is the distance (its square for the Euclidean ones) up to an error of each row."""
    if metric in ("cityblock", "l1", "manhattan"):
        D = np.zeros((len(XL), len(XR)))
        for c in range(XL.shape[1]):
            D += np.abs(XL[:, c, None] - XR[None, :, c])
        return D, 1e-13 * XL.shape[1] * D.max(1)
    a, b = (XL * XL).sum(1), (XR * XR).sum(1)
    return a[:, None] + b[None, :] - 2.0 * (XL @ XR.T), 1e-15 * (XL.shape[1] + 64) * (a + b.max())


TILE_CELLS = 1 << 18  # pairs of rows that are screened at a time, so that a step stays in the cache


def _passed(XL: np.ndarray, XR: np.ndarray, bound: np.ndarray, k: int, same: bool, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row, col) that can be among the ``k`` nearest of their row and within its ``bound`` (of the squared distance for Euclidean ones).

    For Euclidean ones a single-precision matrix product about the left rows' mean screens a tile of rows at a time, its rounding error allowed for;
    where its numbers cannot tell (too large, not finite), and for other metrics, double precision does."""
    if metric not in ("cityblock", "l1", "manhattan"):
        with np.errstate(all="ignore"):
            mean = XL.mean(0)
            A, B = XL - mean, XR - mean
            a, b = (A * A).sum(1), (B * B).sum(1)
        if len(a) and len(b) and max(a.max(), b.max()) < 1e30:  # false for NaN
            A32 = np.hstack([A, np.ones((len(A), 1))]).astype(np.float32)
            B32 = np.ascontiguousarray(np.hstack([B, -b[:, None] / 2]).astype(np.float32).T)
            err = 1.2e-7 * (XL.shape[1] + 16) * (a + b.max()) + 1e-30  # of a + b - 2 A.B, numbers too small for single precision included
            rows, cols = [], []
            step = max(1, TILE_CELLS // len(b))
            for i in range(0, len(a), step):
                s = slice(i, i + step)
                S = A32[s] @ B32  # the larger, the nearer: (a - d^2) / 2
                if same:
                    S[np.arange(len(S)), np.arange(i, i + len(S))] = -np.inf
                limit = bound[s]
                if S.shape[1] > k and np.isinf(limit).any():  # the first block: its own k best bound the rest
                    kth = np.partition(S, S.shape[1] - k, axis=1)[:, S.shape[1] - k].astype(float)
                    limit = np.minimum(limit, np.where(np.isfinite(kth), a[s] - 2 * kth + err[s], np.inf))
                floor = (a[s] - limit * (1 + 1e-12) - err[s]) / 2
                at = np.flatnonzero(S >= np.where(np.isfinite(floor), floor - 1e-6 * np.abs(floor), -3e38).astype(np.float32)[:, None])
                r, c = np.divmod(at, S.shape[1])
                rows.append(r + i), cols.append(c)
            return np.concatenate(rows), np.concatenate(cols)
    G, err = _screen(XL, XR, metric)
    odd = ~np.isfinite(G)
    if same:
        np.fill_diagonal(odd, False)
        np.fill_diagonal(G, np.nan)
    if G.shape[1] > k and np.isinf(bound).any():
        bound = np.minimum(bound, np.partition(np.where(np.isfinite(G), G, np.inf), k - 1, axis=1)[:, k - 1] + 2 * np.where(np.isfinite(err), err, np.inf))
    limit = bound * (1 + 1e-12) + np.where(np.isfinite(err), err, np.inf)
    return np.nonzero((G <= limit[:, None]) | odd)


class _Best:
    """The k nearest of each row so far; what is found waits until it is as much as half of them, then the best are kept."""

    def __init__(self, ids: np.ndarray, dst: np.dtype, k: int):
        self.ids, self.k, self.waiting = ids, k, []
        self.row, self.dst, self.dist, self.worst = np.empty(0, int), np.empty(0, dst), np.empty(0), np.full(len(ids), np.inf)

    def add(self, row: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> None:
        self.waiting.append((row, dst, dist))
        if np.isinf(self.worst).any() or sum(len(r) for r, _, _ in self.waiting) > len(self.ids) * self.k / 2:
            self.settle()

    def settle(self) -> None:
        row, dst, dist = (np.concatenate(x) for x in zip((self.row, self.dst, self.dist), *self.waiting))
        at = np.lexsort((dst, dist, row))
        row, dst, dist = row[at], dst[at], dist[at]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.worst = np.full(len(self.ids), np.inf)
        self.worst[row[last]] = dist[last]
        keep = place < self.k
        self.row, self.dst, self.dist, self.waiting = row[keep], dst[keep], dist[keep], []


def _knn_sweep(k: int, metric: str):
    """The k nearest of each left row over all right blocks, ties to the smaller id.

    Only pairs that can be among the k best so far get their exact distance."""
    if metric not in ("euclidean", "l2", "sqeuclidean", "cityblock", "l1", "manhattan"):
        raise ValueError(metric)

    def run(pairs):
        held: dict[int, _Best] = {}
        with np.errstate(all="ignore"):
            for lb, lt, rb, rt in pairs:
                best = held.setdefault(lb, _Best(lt["id"], rt["id"].dtype, k))
                bound = best.worst ** 2 if metric in ("euclidean", "l2") else best.worst
                r, c = _passed(lt["x"], rt["x"], bound, k, lb == rb, metric)
                d = _exact(lt["x"], rt["x"], r, c, metric)
                fin = np.isfinite(d) & (d <= best.worst[r])
                best.add(r[fin], rt["id"][c[fin]], d[fin])
        for best in held.values():
            best.settle()
            yield pd.DataFrame({"src": best.ids[best.row], "dst": best.dst, "dist": best.dist})
    return run


def _directed_rows(df: DataFrame, n: int, block_rows: int) -> int:
    """Blocks of at most about ``block_rows`` rows, as many for every task; small tables get smaller blocks, so that there are enough to share out."""
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return min(block_rows, max(256, -(-n // (tasks * -(-n // (tasks * block_rows)))))) if n else block_rows


def knn_graph(df: DataFrame, id_col: str, vec: str, k: int = 30, metric: str = "euclidean",
              block_rows: int = 4096) -> DataFrame:
    """K3: the k nearest neighbours of every row as (src, dst, rank, dist).

    A task keeps the k best partners of its rows over all blocks (numpy), so
    a row has k candidates from each task that holds its block before the
    final top-k; ties break on the neighbour id.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(vec).alias("x"))
    n = df.count()
    cand = block_sweep(base, "id", ["x"], _knn_sweep(k, metric), _KNN_SCHEMA, _directed_rows(base, n, block_rows), n, directed=True)
    w = Window.partitionBy("src").orderBy("dist", "dst")
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("src", "dst", F.col("rank").cast("int").alias("rank"), "dist")


SIL_METRICS = ("euclidean", "l1", "chebyshev", "arccos")


def _sil_schema(labels: list[str]) -> str:
    return "src long, labelling string, src_c long, dst_c long, " + ", ".join(f"{m} double" for m in SIL_METRICS)


FLUSH_CELLS = 1 << 22  # partial sums a task holds before it hands them on


SIL_TILE = 64, 512  # left and right rows that are handled at a time, so that a step stays in the cache


def _with_unit(X: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows, and the rows at length 1, each with its squared lengths."""
    U = X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-12)
    return [(A, (A * A).sum(1)) for A in (X, U)]


def _metric_matrices(left: list[tuple], right: list[tuple], out: np.ndarray) -> None:
    """``out`` (metric, left row, right row): the distances of ``SIL_METRICS`` between some rows, given by ``_with_unit``.

    The Euclidean ones come from a matrix product where they are large enough for it (no digit of 6 decimals is lost), else from differences."""
    for m, (A, a), (B, b) in ((0, left[0], right[0]), (3, left[1], right[1])):
        size = a[:, None] + b
        G = A @ B.T
        G *= -2.0
        G += size
        size *= 1e-3
        near = np.less_equal(G, size)
        if near.any() or not np.isfinite(G.sum()):
            r, c = np.nonzero(~(G > size))
            np.sqrt(np.maximum(G, 0.0, out=G), out=out[m])
            out[m][r, c] = _exact(A, B, r, c, "euclidean")
        else:
            np.sqrt(G, out=out[m])
    XL, XR = left[0][0], right[0][0]
    l1, top, diff = (np.zeros(out.shape[1:]) for _ in range(3))
    for c in range(XL.shape[1]):
        np.subtract(XL[:, c, None], XR[:, c], out=diff)
        np.abs(diff, out=diff)
        np.add(l1, diff, out=l1)
        np.maximum(top, diff, out=top)
    out[1], out[2] = l1, top


def _cells(block: dict, labels: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[str, np.ndarray, np.ndarray]]]:
    """Order that puts the rows with the same clusters in all labellings together, where these runs begin, and for each labelling the clusters of
    the runs that are in it with a (run, cluster) matrix of 1 and 0."""
    cs = np.array([block[lab].astype(float) for lab in labels])  # NaN: the row is not in this labelling
    order = np.lexsort(cs[::-1])
    runs = cs[:, order]
    new = np.r_[True, ~((runs[:, 1:] == runs[:, :-1]) | (np.isnan(runs[:, 1:]) & np.isnan(runs[:, :-1]))).all(0)][:runs.shape[1]]
    starts = np.flatnonzero(new)
    out = []
    for lab, of in zip(labels, runs[:, starts]):
        inside = np.flatnonzero(~np.isnan(of))
        keys, at = np.unique(of[inside], return_inverse=True)
        onehot = np.zeros((len(starts), len(keys)))
        onehot[inside, at] = 1.0
        out.append((lab, keys, onehot))
    return order, starts, out


def _sil_sweep(labels: list[str]):
    """Per (row, labelling, cluster) distance sums of a task's left rows over all right blocks: sums over the runs of right rows with the same clusters."""

    def rows_of(held):
        for (lb, lab), (ids, cs, cells) in held.items():
            rows = ~np.isnan(cs)
            for key, sums in cells.items():
                frame = {"src": ids[rows], "labelling": lab, "src_c": cs[rows].astype(np.int64), "dst_c": np.int64(key)}
                yield pd.DataFrame({**frame, **{m: sums[j][rows] for j, m in enumerate(SIL_METRICS)}})

    def run(pairs):
        held, size = {}, 0
        for lb, lt, rb, rt in pairs:
            order, starts, by = _cells(rt, labels)
            own = np.argsort(order)
            left, right = _with_unit(lt["x"]), [(np.asfortranarray(A), a) for A, a in _with_unit(rt["x"][order])]
            sums = np.empty((len(SIL_METRICS), len(lt["id"]), len(starts)))
            for i in range(0, len(lt["id"]), SIL_TILE[0]):
                rows = [(A[i:i + SIL_TILE[0]], a[i:i + SIL_TILE[0]]) for A, a in left]
                mats = np.empty((len(SIL_METRICS), len(rows[0][1]), len(order)))
                for j in range(0, len(order), SIL_TILE[1]):
                    to = slice(j, j + SIL_TILE[1])
                    _metric_matrices(rows, [(A[to], a[to]) for A, a in right], mats[:, :, to])
                if lb == rb:
                    at = np.arange(mats.shape[1])
                    mats[:, at, own[i + at]] = 0.0
                sums[:, i:i + SIL_TILE[0]] = np.add.reduceat(mats, starts, axis=2)
            for lab, keys, onehot in by:
                cs = lt[lab].astype(float)
                if np.isnan(cs).all() or not len(keys):
                    continue
                cells = held.setdefault((lb, lab), (lt["id"], cs, {}))[2]
                for key, part in zip(keys.tolist(), np.moveaxis(sums @ onehot, 2, 0)):
                    if key in cells:
                        cells[key] += part
                    else:
                        cells[key] = part.copy()
                        size += part.size
            if size > FLUSH_CELLS:
                yield from rows_of(held)
                held, size = {}, 0
        yield from rows_of(held)

    return run


def silhouettes(df: DataFrame, id_col: str, vec: str, labels: dict[str, Column], block_rows: int = 1024) -> DataFrame:
    """Mean silhouette as rows (labelling, metric, silhouette) for several labellings in one pass over the pairs.

    ``labels`` maps a name to a column of cluster ids; a row whose id is null takes no part in that labelling.
    A task reduces its rows' distances to all rows in numpy to sums per (row, cluster) and Spark adds up the
    partials; a = own-cluster sum / (n_own - 1), b = min over other
    clusters of the mean; s = (b - a) / max(a, b); a singleton scores 0.
    Null when fewer than 2 or more than n - 1 clusters.  ``arccos`` is Euclidean on normalised vectors.
    """
    names = list(labels)
    base = df.select(F.col(id_col).alias("id"), F.col(vec).alias("x"), *[c.cast("long").alias(n) for n, c in labels.items()])
    n = df.count()
    parts = block_sweep(base, "id", ["x", *names], _sil_sweep(names), _sil_schema(names), _directed_rows(base, n, block_rows), n, directed=True)
    sums = parts.groupBy("labelling", "src", "src_c", "dst_c").agg(*[F.sum(m).alias(m) for m in SIL_METRICS])
    long = base.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("labelling"), F.col(n).alias("c")) for n in names])).alias("e"))
    long = long.select(F.col("id").alias("src"), "e.*").where("c is not null")
    sizes = long.groupBy("labelling", "c").agg(F.count(F.lit(1)).alias("nc"))
    j = sums.join(sizes.withColumnRenamed("c", "dst_c"), ["labelling", "dst_c"])
    own, oth = F.col("src_c") == F.col("dst_c"), F.col("src_c") != F.col("dst_c")
    per = j.groupBy("labelling", "src").agg(
        F.max(F.when(own, F.col("nc"))).alias("n_own"),
        *[F.max(F.when(own & (F.col("nc") > 1), F.col(m) / F.greatest(F.col("nc") - 1, F.lit(1)))).alias(f"a_{m}") for m in SIL_METRICS],
        *[F.min(F.when(oth, F.col(m) / F.col("nc"))).alias(f"b_{m}") for m in SIL_METRICS])
    vals = []
    for m in SIL_METRICS:
        a, b = F.col(f"a_{m}"), F.col(f"b_{m}")
        mx = F.greatest(a, b)
        vals.append(F.when((F.col("n_own") <= 1) | a.isNull() | b.isNull() | (mx == 0), F.lit(0.0)).otherwise((b - a) / mx).alias(m))
    mean = per.select("labelling", *vals).groupBy("labelling").agg(*[F.avg(m).alias(m) for m in SIL_METRICS])
    counts = sizes.groupBy("labelling").agg(F.count(F.lit(1)).alias("k"), F.sum("nc").alias("n"))
    tall = mean.join(counts, "labelling").select("labelling", "k", "n", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("silhouette")) for m in SIL_METRICS])).alias("r"))
    return tall.select("labelling", "r.metric", F.when((F.col("k") >= 2) & (F.col("k") <= F.col("n") - 1), F.col("r.silhouette")).alias("silhouette"))


def silhouette_sheet(pred: DataFrame, spaces: dict[str, DataFrame], id_col: str = "vec_id") -> DataFrame:
    """K15 as named rows (metric, value): 4 metrics x spaces x the four labellings of the live evaluation.

    ``pred``: (id, label, cluster) with cluster -1 for unclustered rows; ``spaces`` maps "" / "-fit" / "-og" to (id, embedding).  Scores that are
    undefined, and ``_pred`` scores of a degenerate clustering, are left out.
    """
    on = F.col("cluster") >= 0
    views = {"true": F.col("label"), "true_clus": F.when(on, F.col("label")), "pred": F.col("cluster"), "pred_clus": F.when(on, F.col("cluster"))}
    guard = pred.agg(F.countDistinct(F.when(on, F.col("cluster"))).alias("kp"), F.countDistinct("cluster").alias("ka"), F.count(F.lit(1)).alias("n"), F.count_if(on).alias("nc"))
    out = None
    for suffix, space in spaces.items():
        s = silhouettes(pred.select(id_col, "label", "cluster").join(space, id_col), id_col, "embedding", views)
        s = s.withColumn("metric", F.concat(F.lit(f"silhouette{suffix}-"), "metric", F.lit("_"), "labelling"))
        out = s if out is None else out.unionByName(s)
    kp, ka, n, nc = (guard.select(c).scalar() for c in ("kp", "ka", "n", "nc"))
    degenerate = (kp <= 1) | (ka >= n)
    keep = F.when(F.col("labelling") == "true", True).when(F.col("labelling") == "true_clus", nc > 0) \
        .when(F.col("labelling") == "pred", ~degenerate).otherwise(~degenerate & (nc > 0) & (kp < nc))
    return out.where("silhouette is not null").where(keep).select("metric", F.col("silhouette").alias("value"))

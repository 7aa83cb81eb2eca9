"""Spectral reduction (K2, non-linear) and spectral clustering (K17) on a neighbour graph.

The eigenvectors of the normalised graph Laplacian L = I - A come from block
subspace iteration with a Chebyshev filter, all of it as DataFrame jobs:

* Nodes are dealt to blocks of about ``block_rows``, those near each other in
  the graph together, so few blocks share edges; a block's rows
  of the m vectors are one packed matrix, and the edges between two blocks one
  packed row.  A product with A is one shuffle: the block of ``dst`` multiplies
  its rows with its edges (numpy) and sends each other block one row for each
  node there that it touches; that block adds up what it gets and takes the
  next step of the filter in the same task.
* Orthogonalisation and Rayleigh-Ritz use m x m Gram matrices, summed from
  those of the blocks; they are all that reaches the driver.
* After each filter the block and its product are checkpointed, so lineage
  stays short.  Cycles end when the residuals |L x - l x| of the wanted
  vectors are at most ``tol``; they are exact numbers, not estimates.

Nothing is collected by node, no vector of length n is on the driver and the
edge list is never broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.hashing import gaussian
from helixframe.operators.cluster import kmeans
from helixframe.operators.indexing import dense_index
from helixframe.session import cut_lineage

BLOCK_ROWS = 16384
EDGES, STATE, SENT, GRAM = range(4)  # kinds of packed rows; each belongs to block b
_PACK_DDL = "b int, kind int, other int, i1 binary, i2 binary, i3 binary, val binary"
_PACK = pa.schema([(c, pa.int32()) for c in ("b", "kind", "other")] + [(c, pa.binary()) for c in ("i1", "i2", "i3", "val")])


def affinity(knn: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions from neighbour edges (src, dst): 1 where both name each other, else 1/2."""
    e = knn.where("src <> dst").select("src", "dst").distinct()
    both = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src", "dst").agg((F.count(F.lit(1)) * 0.5).alias("w"))


def normalised(weights: DataFrame) -> DataFrame:
    """(src, dst, a): D^-1/2 W D^-1/2 of symmetric weights above 0."""
    deg = weights.groupBy("src").agg(F.sum("w").alias("d"))
    e = weights.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    return e.select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).alias("a"))


def _cols(prefix: str, m: int) -> list[str]:
    return [f"{prefix}{j}" for j in range(m)]


def _bytes(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _row(b: int, kind: int, other: int, i1=b"", i2=b"", i3=b"", val=b"") -> tuple:
    return b, kind, other, i1, i2, i3, val


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(_PACK), _PACK.types)], schema=_PACK)


def _packed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges, one row for each pair of blocks with any: it belongs to the block of ``dst`` and has the places of dst, those of src (each once)
    with where their edges begin, and the weights.  ``nodes``: (id, b, pos)."""

    def run(t: pa.Table) -> pa.Table:
        src, dst, w = (t.column(c).to_numpy() for c in ("sp", "dp", "a"))
        at = np.lexsort((dst, src))
        to, starts = np.unique(src[at], return_index=True)
        return _table([_row(t.column("db")[0].as_py(), EDGES, t.column("sb")[0].as_py(), _bytes(dst[at], np.int32), _bytes(starts, np.int32), _bytes(to, np.int32),
                            _bytes(w[at], np.float64))])

    e = edges.join(nodes.select(F.col("id").alias("src"), F.col("b").alias("sb"), F.col("pos").alias("sp")), "src")
    e = e.join(nodes.select(F.col("id").alias("dst"), F.col("b").alias("db"), F.col("pos").alias("dp")), "dst")
    return e.select("sb", "sp", "db", "dp", "a").groupBy("db", "sb").applyInArrow(run, _PACK_DDL)


def _near(edges: DataFrame, ids: DataFrame, rounds: int = 4) -> DataFrame:
    """(id, l): nodes of a part of the graph, or near each other in it, tend to get the same l: the least hash of a node within ``rounds`` edges."""
    parts = 2 * ids.sparkSession.sparkContext.defaultParallelism
    lab = ids.select("id", F.xxhash64(F.lit("near"), "id").alias("l"))
    for _ in range(rounds):
        told = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).join(lab, "id").select(F.col("to").alias("id"), "l")
        lab = cut_lineage(told.unionAll(lab).groupBy("id").agg(F.min("l").alias("l")).coalesce(parts))
    return lab


def _start(nodes: DataFrame, m: int, seed: int) -> DataFrame:
    """The first state: a row for each block with its ids in order and their random values."""

    def run(t: pa.Table) -> pa.Table:
        at = np.argsort(t.column("pos").to_numpy())
        Y = np.column_stack([t.column(f"y{j}").to_numpy() for j in range(m)])
        return _table([_row(t.column("b")[0].as_py(), STATE, 0, _bytes(t.column("id").to_numpy()[at], np.int64), val=_bytes(Y[at], np.float64))])

    return nodes.select("id", "b", "pos", *[gaussian(F.lit(seed), F.lit(j), F.col("id")).alias(f"y{j}") for j in range(m)]).groupBy("b").applyInArrow(run, _PACK_DDL)


def _pass(rows: DataFrame, change, send: bool) -> DataFrame:
    """One step of every block: ``change`` gets its state and the sum Z of what blocks sent to it (None: nothing was sent) and gives the columns to
    send and the next state.  What is sent is their product with the block's edges, summed by src, to the block of src; without ``send`` the
    state's Gram matrix stands in its place."""

    def run(t: pa.Table) -> pa.Table:
        at = {k: [] for k in (EDGES, STATE, SENT)}
        for i, kind in enumerate(t.column("kind").to_pylist()):
            at[kind].append(i)
        get = lambda i, c, kind: np.frombuffer(t.column(c)[i].as_buffer(), kind)
        b, (own,) = t.column("b")[0].as_py(), at[STATE]
        ids = get(own, "i1", np.int64)
        n, Z = len(ids), None
        for i in sorted(at[SENT], key=lambda i: t.column("other")[i].as_py()):
            to = get(i, "i1", np.int32)
            part = get(i, "val", np.float64).reshape(len(to), -1)
            Z = np.zeros((n, part.shape[1])) if Z is None else Z
            Z[to] += part
        out, new = change(get(own, "val", np.float64).reshape(n, -1), Z)
        rows = [_row(b, STATE, 0, _bytes(ids, np.int64), val=_bytes(new, np.float64))]
        if not send:
            rows.append(_row(b, GRAM, 0, val=_bytes(new.T @ new, np.float64)))
        for i in at[EDGES] if send else ():
            part = np.add.reduceat(out[get(i, "i1", np.int32)] * get(i, "val", np.float64)[:, None], get(i, "i2", np.int32), axis=0)
            rows.append(_row(t.column("other")[i].as_py(), SENT, b, t.column("i3")[i].as_py(), val=_bytes(part, np.float64)))
        return _table(rows)

    return rows.groupBy("b").applyInArrow(run, _PACK_DDL)


def _multiplied(sent: DataFrame) -> DataFrame:
    """The state (Y, Z) with Z = A Y, and its Gram matrices; ``sent`` is from the pass before."""
    return _pass(sent, lambda S, Z: (None, np.hstack([S[:, :Z.shape[1]], Z])), send=False)


def _filtered(packed: DataFrame, pairs: DataFrame, C: np.ndarray, degree: int, cut: float) -> DataFrame:
    """What is sent of a scaled Chebyshev polynomial of A that damps [-1, cut], applied to X = Y C; A X is Z C, so the first degree needs no product."""
    c, e = (cut - 1.0) / 2.0, (cut + 1.0) / 2.0
    sigma = e / (1.0 - c)
    tau, m = 2.0 / sigma, C.shape[1]

    def first(S, _, scale=sigma / e):
        X, AX = S[:, :len(C)] @ C, S[:, len(C):] @ C
        Y = (AX - c * X) * scale
        return Y, np.hstack([Y, X])

    def further(s, p):
        def change(S, Z):
            Y = (Z - c * S[:, :m]) * s - S[:, m:] * p
            return Y, np.hstack([Y, S[:, :m]])
        return change

    now = _pass(packed.unionAll(pairs.where(F.col("kind") == STATE)), first, send=True)
    for _ in range(degree - 1):
        s2 = 1.0 / (tau - sigma)
        now = _pass(packed.unionAll(now), further(2.0 * s2 / e, sigma * s2), send=True)
        sigma = s2
    return now


def _grams(pairs: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Y'Y, Y'Z and Z'Z: the blocks' matrices, one partial for each task, summed by entry."""

    def run(batches):
        total = np.zeros(4 * m * m)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_buffer(), np.float64)
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    parts = pairs.where(F.col("kind") == GRAM).select("val").mapInArrow(run, "g array<double>")
    rows = parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # 4 m^2 numbers
    G = np.zeros(4 * m * m)
    for r in rows:
        G[r["i"]] = r["v"]
    G = G.reshape(2 * m, 2 * m)
    return G[:m, :m], G[:m, m:], G[m:, m:]


def _ritz(YY, YZ, ZZ):
    """Ritz values (descending), the rotation to orthonormal Ritz vectors and their residuals; directions that vanished are dropped."""
    scale = 1.0 / np.sqrt(np.maximum(np.diag(YY), np.finfo(float).tiny))
    s, V = np.linalg.eigh(YY * np.outer(scale, scale))
    keep = s > 1e-11 * s[-1]
    W = (scale[:, None] * V[:, keep]) / np.sqrt(s[keep])
    H = W.T @ ((YZ + YZ.T) / 2) @ W
    theta, Q = np.linalg.eigh((H + H.T) / 2)
    order = np.argsort(-theta)
    theta, C = theta[order], W @ Q[:, order]
    r2 = np.einsum("ij,ij->j", C, ZZ @ C) - 2 * theta * np.einsum("ij,ij->j", C, (YZ + YZ.T) / 2 @ C) + theta ** 2 * np.einsum("ij,ij->j", C, YY @ C)
    return theta, C, np.sqrt(np.maximum(r2, 0.0))


def _rotated(pairs: DataFrame, C: np.ndarray) -> DataFrame:
    """(id, x*): Y C, a row for each node again."""
    names = ["id", *_cols("x", C.shape[1])]

    def run(batches):
        for batch in batches:
            for ids, val in zip(batch.column(0), batch.column(1)):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                X = np.frombuffer(val.as_buffer(), np.float64).reshape(len(ids), -1)[:, :len(C)] @ C
                yield pa.record_batch([pa.array(ids), *[pa.array(np.ascontiguousarray(X[:, j])) for j in range(C.shape[1])]], names=names)

    return pairs.where(F.col("kind") == STATE).select("i1", "val").mapInArrow(run, "id bigint, " + ", ".join(f"{c} double" for c in names[1:]))


@dataclass
class Eigen:
    """``vectors``: (id, x0 ..) with orthonormal columns; ``values`` of A, largest first (those of L are 1 - values); residuals; cycles used."""

    vectors: DataFrame
    values: np.ndarray
    residuals: np.ndarray
    cycles: int


def top_eigen(edges: DataFrame, want: int, tol: float = 1e-6, degree: int = 8, guard: int | None = None, seed: int = 0, max_cycles: int = 100,
              block_rows: int = BLOCK_ROWS) -> Eigen:
    """The ``want`` largest eigenpairs of a symmetric A (src, dst, a) with spectrum in [-1, 1] whose every node has an edge.

    ``guard`` further vectors speed up convergence.  With fewer nodes than vectors the block shrinks to the nodes.  Raises if ``tol`` isn't reached in
    ``max_cycles``: residuals below about 1e-8 are out of reach of Gram matrices in double precision.
    """
    edges = cut_lineage(edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "a"))
    ids = edges.select(F.col("src").alias("id")).distinct()
    n = ids.count()
    want = min(want, n)
    m = min(n, want + (guard if guard is not None else max(4, want // 2)))
    if not n:
        raise ValueError("a graph without edges has no spectrum")
    blocks = max(-(-n // block_rows), min(16, -(-n // 512)))
    size = -(-n // blocks)
    at = F.col("at")
    nodes = dense_index(_near(edges, ids), ["l", "id"], name="at").select("id", (at / size).cast("int").alias("b"), F.pmod(at, F.lit(size)).cast("int").alias("pos"))
    nodes = cut_lineage(nodes)
    packed = cut_lineage(_packed(edges, nodes))
    sent = _pass(packed.unionAll(_start(nodes, m, seed)), lambda Y, _: (Y, Y), send=True)
    cycles = 0
    while True:
        pairs = cut_lineage(_multiplied(sent))
        theta, C, res = _ritz(*_grams(pairs, m))
        have = min(want, len(theta))
        if cycles and have == want and res[:want].max() <= tol:
            return Eigen(_rotated(pairs, C[:, :want]), theta[:want], res[:want], cycles)
        if cycles >= max_cycles:
            raise RuntimeError(f"residual {res[:have].max():.2e} after {cycles} cycles, asked for {tol:.0e}")
        sent = _filtered(packed, pairs, C, degree, float(np.clip(theta[-1], -0.9, 1 - 1e-6)))
        m, cycles = C.shape[1], cycles + 1


def spectral_embedding(knn: DataFrame, dims: int, tol: float = 1e-6, seed: int = 0, out: str = "reduced") -> tuple[DataFrame, Eigen]:
    """K2, non-linear: (id, ``out`` array<double>) of ``dims`` coordinates from a neighbour graph (src, dst).

    Coordinates are the Laplacian eigenvectors after the first, divided by the square root of the node's degree; each one's sign makes its
    entry of largest magnitude positive.  A graph in several parts has one coordinate for each further part first.
    """
    w = cut_lineage(affinity(knn))
    eig = top_eigen(normalised(w), dims + 1, tol, seed=seed)
    k = len(eig.values)
    deg = w.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    y = cut_lineage(eig.vectors.join(deg, "id").select("id", *[(F.col(f"x{j}") / F.sqrt("d")).alias(f"x{j}") for j in range(1, k)]))
    signs = y.agg(*[F.max_by(F.signum(f"x{j}"), F.struct(F.round(F.abs(f"x{j}"), 9), -F.col("id"))) for j in range(1, k)]).first() or []
    return y.select("id", F.array(*[F.col(f"x{j}") * F.lit(float(s or 1.0)) for j, s in zip(range(1, k), signs)]).cast("array<double>").alias(out)), eig


def spectral_clustering(knn: DataFrame, k: int, tol: float = 1e-6, seed: int = 0) -> DataFrame:
    """(id, cluster) by k-means on the rows of the first k eigenvectors, scaled to length 1; clusters are numbered by their smallest id."""
    eig = top_eigen(normalised(cut_lineage(affinity(knn))), k, tol, seed=seed)
    names = _cols("x", len(eig.values))
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)))
    rows = cut_lineage(eig.vectors.select("id", F.array(*[F.col(c) / F.greatest(norm, F.lit(1e-300)) for c in names]).alias("u")))
    pred, _ = kmeans(rows, "id", "u", k, seed=seed, max_iter=100)
    pred = cut_lineage(pred)
    order = dense_index(pred.groupBy("cluster").agg(F.min("id").alias("root")), ["root"], name="_pos")
    return pred.join(order.select("cluster", "_pos"), "cluster").select("id", F.col("_pos").cast("int").alias("cluster"))

"""Ward agglomerative clustering (K4): exact, by rounds of reciprocal nearest neighbours with pruned block search.

Ward is reducible, so all mutual nearest pairs of a round can merge at once
and the tree equals the one of sequential merging.  A round:

1. Blocks are zones around pivots, split by a hash to at most ``block_rows``
   rows, so a block is a small region of space, packed into one row.  Rows
   without a partner (new clusters and those whose partner has gone) ask the
   block they lie in, in the task that packs it.
2. That answer bounds the height of the asker's nearest partner.  A block
   whose bounding box (in axes turned to the spread of the pivots) is far
   enough from the asker holds neither a nearer partner for it nor a row that
   the asker is nearer to than its own partner; only the other blocks are
   asked.  Packed askers meet them by Spark's cartesian product, so no row is
   copied to the blocks it asks.
3. Mutual pairs are an equi-join; merged clusters are placed anew.

State and merges are checkpointed every round.  What reaches the driver in a
round: a count and 2 d + 2 numbers for each block.  The last ``finish_rows``
clusters, a constant however large the data (no matrix of them is held), are
merged in one task by the same rounds, where a round costs no job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.indexing import dense_index
from helixframe.session import cut_lineage

_NEAREST = "cid bigint, h double, p bigint"
_STATE = "cid bigint, n bigint, s array<double>, blk bigint"
_SPLIT = 1 << 20  # sub-blocks a zone can have
_SLACK = 1e-9


def _heights(na, ca, nb, cb) -> np.ndarray:
    """Merge heights of all pairs, by plain differences, 16 rows at a time, so a common shift costs no precision."""
    h = np.empty((len(ca), len(cb)))
    for a in range(0, len(ca), 16):
        at = slice(a, a + 16)
        diff = ca[at, None, :] - cb[None, :, :]
        h[at] = (diff * diff).sum(-1) * (na[at, None] * nb[None, :] / (na[at, None] + nb[None, :]))
    return h


def _candidate_heights(na, ca, nb, cb, same: np.ndarray) -> np.ndarray:
    """The heights, by plain differences, of the pairs that can be the least of their row or column; infinite for the others and for ``same``.

    A matrix product of the centred rows screens the pairs, its rounding error allowed for; pairs it cannot judge (not finite) are computed."""
    with np.errstate(all="ignore"):
        mean = cb.mean(0)
        A, B = ca - mean, cb - mean
        a, b = (A * A).sum(1)[:, None], (B * B).sum(1)[None, :]
        weight = na[:, None] * nb[None, :] / (na[:, None] + nb[None, :])
        quick = (a + b - 2.0 * (A @ B.T)) * weight
        slip = 1e-15 * (ca.shape[1] + 64) * (a + b) * weight
        odd = ~(np.isfinite(quick) & np.isfinite(slip))
        high = np.where(odd | same, np.inf, quick + slip)
        low = quick - slip
        r, c = np.nonzero(((low <= high.min(1)[:, None]) | (low <= high.min(0)[None, :]) | odd) & ~same)
    h = np.full(same.shape, np.inf)
    for at in range(0, len(r), 16384):
        i, j = r[at:at + 16384], c[at:at + 16384]
        diff = ca[i] - cb[j]
        h[i, j] = (diff * diff).sum(-1) * weight[i, j]
    return h


def _nearest(nq, cq, at, nt, ct, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some askers (sizes, centres, their place among the targets or -1): height and place of the nearest target, ties to the first; and the
    pairs (height, target, asker) that are no higher than the target's ``known`` height (-inf: not wanted).

    As in ``_candidate_heights`` a matrix product screens the pairs, here some rows at a time and in place, so memory is not askers x targets."""
    best, place = np.full(len(nq), np.inf), np.zeros(len(nq), np.int64)
    back: list[tuple] = []
    with np.errstate(all="ignore"):
        mean = ct.mean(0)
        A, B = cq - mean, ct - mean
        a, b = (A * A).sum(1), (B * B).sum(1)
        plain = len(a) and len(b) and np.isfinite(a.max() + b.max()) and (a.max() + b.max()) * max(nq.max(), nt.max()) < 1e300
    B2, wt = -2.0 * B.T, 1.0 / nt
    step = max(1, (1 << 18) // max(1, len(nt)))
    for k in range(0, len(nq), step):
        s = slice(k, k + step)
        own = np.flatnonzero(at[s] >= 0)
        if plain:
            G = A[s] @ B2
            G += b
            G += a[s, None]
            G /= 1.0 / nq[s, None] + wt
            slip = 1e-15 * (ct.shape[1] + 64) * (a[s] + b.max()) * np.minimum(nq[s], nt.max())
            G[own, at[s][own]] = np.inf
            r, c = np.nonzero((G <= (G.min(1) + 2 * slip)[:, None]) | (G <= known + slip.max()))
            keep = np.isfinite(G[r, c])
            r, c = r[keep] + k, c[keep]
            h = np.empty(len(r))
            for e in range(0, len(r), 16384):
                i, j = r[e:e + 16384], c[e:e + 16384]
                diff = cq[i] - ct[j]
                h[e:e + 16384] = (diff * diff).sum(-1) * (nq[i] * nt[j] / (nq[i] + nt[j]))
        else:
            same = np.zeros((len(nq[s]), len(nt)), bool)
            same[own, at[s][own]] = True
            with np.errstate(all="ignore"):
                whole = np.where(same, np.inf, _heights(nq[s], cq[s], nt, ct))
            r, c = np.nonzero(np.isfinite(whole))
            h = whole[r, c]
            r = r + k
        order = np.lexsort((c, h, r))
        rows, first = np.unique(r[order], return_index=True)
        best[rows], place[rows] = h[order][first], c[order][first]
        again = h <= known[c]
        back.append((h[again], c[again], r[again]))
    back.append((np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)))
    return best, place, tuple(np.concatenate(x) for x in zip(*back))


def _improve(h: np.ndarray, p: np.ndarray, height: np.ndarray, at: np.ndarray, partner: np.ndarray) -> None:
    """Rows ``at`` take the least (height, partner) offered to them where it is less than theirs."""
    order = np.lexsort((partner, height, at))
    at, height, partner = at[order], height[order], partner[order]
    first = np.r_[True, at[1:] != at[:-1]][:len(at)]
    at, height, partner = at[first], height[first], partner[first]
    less = (height < h[at]) | ((height == h[at]) & (partner < p[at]))
    h[at[less]], p[at[less]] = height[less], partner[less]


def _nearest_pivot(X: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty(len(X), np.int64)
    for a in range(0, len(X), 64):
        diff = X[a:a + 64, None, :] - pivots[None, :, :]
        out[a:a + 64] = (diff * diff).sum(-1).argmin(1)
    return out


def _placed(rows: DataFrame, pivots: np.ndarray, splits: dict[int, int], parts: int) -> DataFrame:
    """(cid, n, s) with the block of the nearest pivot; no partner yet."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cid, n = (batch.column(c).to_numpy() for c in ("cid", "n"))
            zone = _nearest_pivot(batch.column("s").flatten().to_numpy().reshape(len(cid), -1) / n[:, None], pivots)
            cut = np.array([splits.get(int(z), 1) for z in zone])
            # a multiplicative hash of the id deals a zone's rows over its sub-blocks
            sub = ((cid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % cut
            yield pa.record_batch([*[batch.column(c) for c in ("cid", "n", "s")], pa.array(zone * _SPLIT + sub)], names=["cid", "n", "s", "blk"])

    out = rows.select("cid", "n", "s").coalesce(parts).mapInArrow(run, _STATE)
    none = lambda k: F.lit(None).cast(k)
    return out.select("cid", "n", "s", none("double").alias("h"), none("bigint").alias("p"), "blk")


class _Frame:
    """Pivots and a rotation about their mean that gathers the spread of the data in few axes (it keeps distances)."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.mean = pivots, pivots.mean(0)
        self.turn = np.linalg.svd(pivots - self.mean, full_matrices=True)[2].T

    def turned(self, X: np.ndarray) -> np.ndarray:
        return (X - self.mean) @ self.turn


_BLOCK = "blk bigint, asking int, ids binary, n binary, c binary, h binary, p binary, box array<double>"
_BLOCK_PA = pa.schema([("blk", pa.int64()), ("asking", pa.int32()), *[(c, pa.binary()) for c in ("ids", "n", "c", "h", "p")], ("box", pa.list_(pa.float64()))])
_NEAREST_PA = pa.schema([("cid", pa.int64()), ("h", pa.float64()), ("p", pa.int64())])


def _blocks(state: DataFrame, frame: _Frame, parts: int, counter) -> DataFrame:
    """One packed row for each block: its rows by id, askers with the best partner of their own block (h infinite if none) last; and its box: the least size,
    the largest height of the others (-1 if none), the least and largest turned coordinates."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cid")
        ids, n = t.column("cid").to_numpy(), t.column("n").to_numpy().astype(float)
        c = t.column("s").combine_chunks().flatten().to_numpy().reshape(len(ids), -1) / n[:, None]
        p, h = t.column("p").fill_null(-1).to_numpy().copy(), t.column("h").fill_null(np.inf).to_numpy().copy()
        asks = np.array(t.column("p").is_null())
        q = np.flatnonzero(asks)
        Y = frame.turned(c)
        box = np.r_[n.min(), h[~asks].max() if not asks.all() else -1.0, Y.min(0), Y.max(0)]
        counter.add(len(q) * len(ids))
        known = np.where(asks, -np.inf, h)
        best, place, (bh, bt, ba) = _nearest(n[q], c[q], q, n, c, known)
        h[q], p[q] = best, np.where(np.isfinite(best), ids[place], -1)
        _improve(h, p, bh, bt, ids[q[ba]])
        order = np.r_[np.flatnonzero(~asks), q]
        packed = [np.ascontiguousarray(x[order]).tobytes() for x in (ids, n, c, h, p)]
        return pa.table([[t.column("blk")[0].as_py()], [len(q)], *[[x] for x in packed], [box.tolist()]], schema=_BLOCK_PA)

    return cut_lineage(state.groupBy("blk").applyInArrow(run, _BLOCK).coalesce(parts))


def _unpacked(row) -> tuple[np.ndarray, ...]:
    ids, n, c, h, p = (np.frombuffer(row[k].as_buffer(), kind) for k, kind in (("ids", np.int64), ("n", float), ("c", float), ("h", float), ("p", np.int64)))
    return ids, n, c.reshape(len(ids), -1), h, p


def _asking(blocks: DataFrame, frame: _Frame, parts: int, boxes: dict[int, np.ndarray]) -> DataFrame:
    """(blk, ids, n, c, h, p, targets): the askers of every block that must ask further blocks, and those blocks."""
    keys = np.array(sorted(boxes))
    least, high, lo, hi = _sides(np.array([boxes[k] for k in keys.tolist()]))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                m = row["asking"].as_py()
                ids, n, c, h, p = (x[-m:] for x in _unpacked(row))
                low = _box_heights(frame.turned(c), n, least, lo, hi)
                ask = ((low <= h[:, None]) | (low <= high)) & (keys != row["blk"].as_py())
                some = ask.any(1)
                if some.any():
                    packed = [np.ascontiguousarray(x[some]).tobytes() for x in (ids, n, c, h, p)]
                    yield pa.record_batch([[row["blk"].as_py()], *[[x] for x in packed], [keys[ask.any(0)].tolist()]], schema=out)

    names = "ids binary, n binary, c binary, h binary, p binary"
    out = pa.schema([("blk", pa.int64()), *[(c, pa.binary()) for c in ("ids", "n", "c", "h", "p")], ("targets", pa.list_(pa.int64()))])
    # few partitions: each is paired with all of the blocks' partitions
    return cut_lineage(blocks.where("asking > 0").mapInArrow(run, f"blk bigint, {names}, targets array<bigint>").coalesce(max(1, parts // 4)))


def _sides(box: np.ndarray) -> tuple[np.ndarray, ...]:
    d = (box.shape[1] - 2) // 2
    return box[:, 0], box[:, 1], box[:, 2:2 + d], box[:, 2 + d:]


def _box_heights(Y: np.ndarray, n: np.ndarray, least: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(row, block): no row of the block is nearer; the distance from a point to a box bounds the one to every row in it."""
    gap2 = np.empty((len(Y), len(least)))
    for k in range(len(least)):
        gap = np.maximum(np.maximum(lo[k] - Y, Y - hi[k]) - _SLACK * (1.0 + np.abs(Y)), 0.0)
        gap2[:, k] = (gap * gap).sum(-1)
    return gap2 * (n[:, None] * least / (n[:, None] + least)) * (1 - _SLACK)


def _asked(frame: _Frame, counter):
    """Kernel over pairs of (askers, block): the best partner of every asker over the blocks, and of the blocks' rows that an asker is no farther from."""

    def run(batches):
        held, cid, hs, ps = {}, [], [], []
        for batch in batches:
            for k in range(batch.num_rows):
                left = {c: batch.column(f"l_{c}")[k] for c in ("ids", "n", "c", "h", "p")}
                right = {c: batch.column(c)[k] for c in ("ids", "n", "c", "h", "p")}
                iq, nq, cq, hq, pq = _unpacked(left)
                hq, pq = held.setdefault(batch.column("l_blk")[k].as_py(), (iq, hq.copy(), pq.copy()))[1:]
                it, nt, ct, ht, pt = _unpacked(right)
                least, high, lo, hi = _sides(np.array(batch.column("box")[k].as_py())[None, :])
                low = _box_heights(frame.turned(cq), nq, least, lo, hi)[:, 0]
                q = np.flatnonzero((low <= hq) | (low <= high[0]))
                if not len(q):
                    continue
                counter.add(len(q) * len(it))
                by = np.argsort(it)
                it, nt, ct, ht, pt = (x[by] for x in (it, nt, ct, ht, pt))
                # askers of that block ask for themselves
                known = np.where(np.isin(np.arange(len(it)), np.flatnonzero(by >= len(it) - batch.column("asking")[k].as_py())), -np.inf, ht)
                best, place, (bh, bt, ba) = _nearest(nq[q], cq[q], np.full(len(q), -1), nt, ct, known)
                new = (best < hq[q]) | ((best == hq[q]) & np.isfinite(best) & (it[place] < pq[q]))
                hq[q[new]], pq[q[new]] = best[new], it[place[new]]
                cid.append(it[bt]), hs.append(bh), ps.append(iq[q[ba]])
        for ids, h, p in held.values():
            cid.append(ids), hs.append(h), ps.append(p)
        if cid:
            cid, h, p = (np.concatenate(x) for x in (cid, hs, ps))
            ok = np.isfinite(h)
            yield pa.record_batch([pa.array(cid[ok].astype(np.int64)), pa.array(h[ok].astype(float)), pa.array(p[ok].astype(np.int64))], schema=_NEAREST_PA)

    return run


def _rows_of(batches):
    """(cid, h, p) of the rows of packed blocks that have a partner."""
    for batch in batches:
        for k in range(batch.num_rows):
            cid, h, p = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in (("ids", np.int64), ("h", float), ("p", np.int64)))
            ok = np.isfinite(h)
            yield pa.record_batch([pa.array(cid[ok]), pa.array(h[ok]), pa.array(p[ok])], schema=_NEAREST_PA)


def _with_nearest(state: DataFrame, frame: _Frame, parts: int, counter) -> DataFrame:
    """``state`` with the nearest partner (h, p) of every cluster, checkpointed."""
    blocks = _blocks(state, frame, parts, counter)
    best = blocks.mapInArrow(_rows_of, _NEAREST)
    boxes = {r["blk"]: np.array(r["box"]) for r in blocks.select("blk", "box").collect()}  # 2 d + 2 numbers for each block
    if len(boxes) > 1:
        left = _asking(blocks, frame, parts, boxes)
        left = left.select("targets", *[F.col(c).alias(f"l_{c}") for c in ("blk", "ids", "n", "c", "h", "p")])
        pairs = left.hint("shuffle_replicate_nl").crossJoin(blocks).where(F.expr("array_contains(targets, blk)")).drop("targets")
        best = best.unionByName(pairs.coalesce(parts).mapInArrow(_asked(frame, counter), _NEAREST))
    best = best.groupBy("cid").agg(F.min(F.struct("h", "p")).alias("m"))
    j = state.select("cid", "n", "s", "blk").join(best, "cid", "left")
    return cut_lineage(j.select("cid", "n", "s", F.col("m.h").alias("h"), F.col("m.p").alias("p"), "blk").coalesce(parts))


def _mutual(state: DataFrame) -> DataFrame:
    a = state.select(F.col("cid").alias("a"), F.col("p").alias("b"), "h").where("a < b")
    b = state.select(F.col("cid").alias("b"), F.col("p").alias("a")).where("a < b")
    return a.join(b, ["a", "b"])


def _merged_in_task(ids: np.ndarray, n: np.ndarray, s: np.ndarray, round_: int, counter=None) -> list[tuple]:
    """All merges (a, b, h, round) among clusters sorted by id; memory grows with the clusters, not with their pairs."""
    out, r = [], round_
    n, s = n.astype(float), s.copy()
    c, h, p = s / n[:, None], np.full(len(ids), np.inf), np.full(len(ids), -1)
    while len(ids) > 1:
        q = np.flatnonzero(p < 0)
        best, place, (bh, bt, ba) = _nearest(n[q], c[q], q, n, c, np.where(p < 0, -np.inf, h))
        if counter is not None:
            counter.add(len(q) * len(ids))
        h[q], p[q] = best, np.where(np.isfinite(best), place, -1)
        _improve(h, p, bh, bt, q[ba])
        a = np.flatnonzero((p >= 0) & (p[p] == np.arange(len(ids))) & (np.arange(len(ids)) < p))
        if not len(a):
            raise RuntimeError("Ward round without a mutual pair (non-finite heights?)")
        b = p[a]
        out += [(int(ids[i]), int(ids[j]), float(h[i]), r) for i, j in zip(a, b)]
        n[a], s[a] = n[a] + n[b], s[a] + s[b]
        c[a] = s[a] / n[a][:, None]
        changed = np.zeros(len(ids) + 1, bool)
        changed[a], changed[b] = True, True
        lost = changed[p] | changed[:-1]
        h[lost], p[lost] = np.inf, -1
        keep = np.ones(len(ids), bool)
        keep[b] = False
        p = np.where(p >= 0, np.cumsum(keep)[p] - 1, -1)
        ids, n, s, c, h, p = (x[keep] for x in (ids, n, s, c, h, p))
        r += 1
    return out


def _finished(state: DataFrame, round_: int, counter) -> DataFrame:
    """All merges left among a bounded number of clusters: the same rounds in one task, where a round costs no job."""

    def run(batches):
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("cid")
        s = t.column("s").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        rows = _merged_in_task(t.column("cid").to_numpy(), t.column("n").to_numpy(), s, round_, counter)
        yield pa.record_batch([pa.array(list(c), k.type) for c, k in zip(zip(*rows) if rows else [()] * 4, out)], schema=out)

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("h", pa.float64()), ("round", pa.int32())])
    return state.select("cid", "n", "s").repartition(1).mapInArrow(run, "a bigint, b bigint, h double, round int")


def ward_merges(df: DataFrame, id_col: str, vec: str, block_rows: int = 4096, finish_rows: int = 16384, n_pivots: int | None = None, report: dict | None = None) -> DataFrame:
    """Full Ward merge table (a, b, h, round) with n - 1 rows; merged cluster keeps id min(a, b).

    The nearest partner of a cluster is the minimum of (h, partner id); the globally smallest pair is
    always mutual under that order, so every round merges at least one pair, and rounds run until one
    cluster is left.  A chain-like input merges few pairs a round: the rounds then grow with the rows beyond ``finish_rows``.
    ``report`` receives the rounds run as jobs and the pairs compared.
    """
    spark = df.sparkSession
    counter = spark.sparkContext.accumulator(0)
    points = cut_lineage(df.select(F.col(id_col).cast("bigint").alias("cid"), F.lit(1).cast("bigint").alias("n"), F.col(vec).cast("array<double>").alias("s")))
    active = points.count()
    rounds, state = [], points
    parts = max(2 * spark.sparkContext.defaultParallelism, active // 65536)
    if active > max(1, finish_rows):
        # a bounded sample of rows as pivots, drawn by hash: at most 1,024 however large the table
        take = n_pivots or min(1024, max(1, active // 2048))
        pivots = np.array([r["s"] for r in points.orderBy(F.xxhash64(F.lit("pivot"), "cid"), "cid").limit(take).collect()])
        zones = _placed(points, pivots, {}, parts).groupBy((F.col("blk") / _SPLIT).cast("bigint").alias("z")).agg(F.count(F.lit(1)).alias("m")).collect()
        splits = {r["z"]: -(-r["m"] // block_rows) for r in zones}
        state = _placed(points, pivots, splits, parts)
        frame = _Frame(pivots)
    while active > max(1, finish_rows):
        before = state.coalesce(parts).persist()  # kept for the round only; lost parts are made anew from the last checkpoint
        state = _with_nearest(before, frame, parts, counter)
        before.unpersist()
        mutual = cut_lineage(_mutual(state).withColumn("round", F.lit(len(rounds))).coalesce(parts))
        merged = mutual.count()
        if merged == 0:
            raise RuntimeError("Ward round without a mutual pair (non-finite heights?)")
        gone = mutual.select(F.explode(F.array("a", "b")).alias("x"))
        # both halves of a pair meet under its smaller id
        pair = mutual.select(F.explode(F.array(F.struct(F.col("a").alias("cid"), F.col("a").alias("to")), F.struct(F.col("b").alias("cid"), F.col("a").alias("to")))).alias("e")).select("e.*")
        halves = state.select("cid", "n", "s").join(pair, "cid").groupBy("to").agg(F.sum("n").alias("n"), F.collect_list("s").alias("two"))
        new = halves.select(F.col("to").alias("cid"), "n", F.zip_with(F.col("two")[0], F.col("two")[1], lambda x, y: x + y).alias("s"))
        left = state.join(gone.withColumnRenamed("x", "cid"), "cid", "left_anti")
        lost = left.join(gone.select(F.col("x").alias("p"), F.lit(True).alias("_lost")), "p", "left")
        still = F.col("_lost").isNull()
        left = lost.select("cid", "n", "s", F.when(still, F.col("h")).alias("h"), F.when(still, F.col("p")).alias("p"), "blk")
        state = left.unionByName(_placed(new, pivots, splits, parts))
        rounds.append(mutual)
        active -= merged
    if active > 1:
        rounds.append(cut_lineage(_finished(state, len(rounds), counter)))
    if report is not None:
        report.update(rounds=len(rounds), pairs=counter.value)
    if not rounds:
        return spark.createDataFrame([], "a bigint, b bigint, h double, round int")
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def cut_tree(points: DataFrame, id_col: str, merges: DataFrame, k: int) -> DataFrame:
    """Labels for a cut at k clusters: drop the k - 1 highest merges (by position, so k may grow with the
    data), then the components of the remaining merges by pointer jumping."""
    ranked = dense_index(merges.withColumn("_nh", -F.col("h")).withColumn("_na", -F.col("a")).withColumn("_nb", -F.col("b")), ["_nh", "_na", "_nb"], name="_pos")
    par = cut_lineage(ranked.where(F.col("_pos") >= max(k - 1, 0)).select(F.col("b").alias("node"), F.col("a").alias("parent")))
    while True:
        p2 = par.select(F.col("node").alias("parent"), F.col("parent").alias("gp"))
        nxt = cut_lineage(par.join(p2, "parent", "left").select(
            "node", F.coalesce("gp", "parent").alias("parent"), F.col("gp").isNotNull().alias("moved")))
        par = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    lab = points.select(F.col(id_col).alias("node")).join(par, "node", "left").select(
        F.col("node").alias(id_col), F.coalesce("parent", "node").alias("root"))
    roots = dense_index(lab.select("root").distinct(), ["root"], name="_pos")
    return lab.join(roots.select("root", F.col("_pos").cast("int").alias("cluster")), "root").select(id_col, "cluster")


def ward(df: DataFrame, id_col: str, vec: str, k: int, block_rows: int = 4096, **options) -> DataFrame:
    """K4: (id, cluster) for Ward's minimum-variance clustering cut at k clusters."""
    return cut_tree(df, id_col, ward_merges(df, id_col, vec, block_rows, **options), k)

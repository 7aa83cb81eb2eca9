"""Cluster scores (contingency family and geometry family).

The contingency family (AMI, ARI, FMS, homogeneity, completeness) reads only
the contingency table, which has at most min(n, k_true * k_pred) rows; the
input is reduced to it by one partially-aggregated shuffle.  The geometry
family reads per-(cluster, dim) sums, again a partial aggregation, so the
vectors themselves are scanned once (twice for Davies-Bouldin, which needs
distances to centroids).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import vectors as V
from helixframe.functions.mathx import xlogx
from helixframe.operators.common import zip_rows
from helixframe.operators.pairs import block_apply
from helixframe.session import cut_lineage

EPS64 = 2.220446049250313e-16


def contingency(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """K6: (label, cluster, n) - one row per non-empty cell."""
    return df.groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"))


def contingency_stats(cont: DataFrame) -> DataFrame:
    """One row of sufficient statistics for the pair-counting scores.

    MI = (sum n_ij ln n_ij + n ln n - sum a ln a - sum b ln b) / n, so no
    join of cells to marginals is needed: the cells and both marginals are
    stacked and reduced by a single aggregate.
    """
    a = cont.groupBy("label").agg(F.sum("n").alias("m")).select(F.lit("true").alias("kind"), "m")
    b = cont.groupBy("cluster").agg(F.sum("n").alias("m")).select(F.lit("pred").alias("kind"), "m")
    cells = cont.select(F.lit("cell").alias("kind"), F.col("n").alias("m"))
    t = cells.unionByName(a).unionByName(b)
    m = F.col("m")
    sq = m.cast("double") * m

    def on(kind, c):
        return F.when(F.col("kind") == kind, c)
    s = t.agg(F.coalesce(F.sum(on("cell", sq)), F.lit(0.0)).alias("sq_cells"),
              F.coalesce(F.sum(on("cell", xlogx(m))), F.lit(0.0)).alias("xlx_cells"),
              F.coalesce(F.sum(on("true", m)), F.lit(0)).alias("n_total"),
              F.count(on("true", m)).alias("k_true"), F.count(on("pred", m)).alias("k_pred"),
              F.coalesce(F.sum(on("true", sq)), F.lit(0.0)).alias("sq_true"),
              F.coalesce(F.sum(on("pred", sq)), F.lit(0.0)).alias("sq_pred"),
              F.coalesce(F.sum(on("true", xlogx(m))), F.lit(0.0)).alias("xlx_true"),
              F.coalesce(F.sum(on("pred", xlogx(m))), F.lit(0.0)).alias("xlx_pred"))
    n = F.col("n_total").cast("double")
    h_true = F.when(n > 0, F.log(n) - F.col("xlx_true") / n).otherwise(F.lit(1.0))
    h_pred = F.when(n > 0, F.log(n) - F.col("xlx_pred") / n).otherwise(F.lit(1.0))
    mi_raw = (F.col("xlx_cells") + n * F.log(n) - F.col("xlx_true") - F.col("xlx_pred")) / n
    mi = F.when((F.col("k_true") <= 1) | (F.col("k_pred") <= 1), F.lit(0.0)).otherwise(
        F.greatest(mi_raw, F.lit(0.0)))
    return s.select("*", h_true.alias("h_true"), h_pred.alias("h_pred"), mi.alias("mi"))


def _ari(st) -> F.Column:
    n = F.col("n_total").cast("double")
    tp = F.col("sq_cells") - n
    fp = F.col("sq_pred") - F.col("sq_cells")
    fn = F.col("sq_true") - F.col("sq_cells")
    tn = n * n - fp - fn - F.col("sq_cells")
    return F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        F.lit(2.0) * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))


def _fms() -> F.Column:
    n = F.col("n_total").cast("double")
    tk = F.col("sq_cells") - n
    pk = F.col("sq_pred") - n
    qk = F.col("sq_true") - n
    return F.when(tk != 0, F.sqrt(tk / pk) * F.sqrt(tk / qk)).otherwise(F.lit(0.0))


RATIO_CHUNK = 8192  # terms of the hypergeometric sum that one numpy step takes
TAIL = 1e-17  # what a side's rest may weigh at most against the sum so far
SIZE_BLOCK = 256


def size_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, ma, b, mb): every pair of distinct cluster sizes, joined block by block."""
    na, nb = (max(1, -(-d.count() // SIZE_BLOCK)) for d in (a, b))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).alias("_k" + c)
    every = lambda c, n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("_k" + c)
    left = a.select("a", "ma", block("a", na), every("b", nb))
    right = b.select("b", "mb", every("a", na), block("b", nb))
    return left.join(right, ["_ka", "_kb"]).drop("_ka", "_kb")


def hypergeometric_expectation(a: int, b: int, N: int) -> float:
    """E[k/N log(N k / (a b))] for k the overlap of random sets of ``a`` and ``b`` of ``N`` rows.

    Weights relative to the mode are running products of the ratio P(k+1)/P(k), taken outwards ``RATIO_CHUNK`` terms at a time, and the
    sum of the weights normalises them, so no factorial of a large number is needed.  A side ends at the end of the range, or where its
    whole rest is proved below the last digit: ratios only fall outwards, so the rest weighs at most w * r / (1 - r), and no term's
    factor exceeds ``top``.  About 80 standard deviations are visited, whatever the length of the range.
    """
    lo, hi = max(0, a + b - N), min(a, b)
    mode = min(hi, max(lo, (a + 1) * (b + 1) // (N + 2)))
    top = hi / N * max(np.log(N), 1.0)
    factor = lambda k: k / N * np.log(np.maximum(k, 1) * (N / a) / b)  # noqa: E731  (0 for k = 0)
    weight, value = 1.0, float(factor(np.float64(mode)))
    for step in (1, -1):
        w, k, end = 1.0, mode, hi if step > 0 else lo
        while k != end:
            n = min(RATIO_CHUNK, abs(end - k))
            at = k + step * np.arange(n, dtype=np.float64)
            if step > 0:
                r = (a - at) * (b - at) / ((at + 1) * (N - a - b + at + 1))
            else:
                r = at * (N - a - b + at) / ((a - at + 1) * (b - at + 1))
            ws = w * np.cumprod(r)
            weight += ws.sum()
            value += (ws * factor(at + step)).sum()
            w, k, last = float(ws[-1]), k + step * n, float(r[-1])
            if last < 1 and w * last / (1 - last) * max(top, 1.0) < TAIL * min(weight, abs(value) or weight):
                break
    return value / weight


def _expectations(batches):
    for pdf in batches:
        t = [hypergeometric_expectation(int(a), int(b), int(n)) * ma * mb for a, b, ma, mb, n in zip(pdf["a"], pdf["b"], pdf["ma"], pdf["mb"], pdf["N"])]
        yield pd.DataFrame({"t": np.array(t, float)})


def expected_mutual_information(cont: DataFrame) -> DataFrame:
    """E[MI] under the hypergeometric model, grouped by distinct cluster sizes.

    Cells are (size a, size b) pairs with multiplicities; both size tables
    have at most sqrt(2n) rows (distinct sizes sum to at most n).  A pair is one
    row and one number; its sum runs in numpy inside the task.
    """
    a = cont.groupBy("label").agg(F.sum("n").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("ma"))
    b = cont.groupBy("cluster").agg(F.sum("n").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("mb"))
    pairs = size_pairs(a, b).withColumn("N", cont.agg(F.sum("n").cast("bigint")).scalar())
    return pairs.select("a", "b", "ma", "mb", "N").mapInPandas(_expectations, "t double").agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("emi"))


def pair_scores(df: DataFrame, label: str = "label", cluster: str = "cluster",
                with_ami: bool = True) -> DataFrame:
    """K7-K11 in one row: ami, ari, fms, homogeneity, completeness (+ stats).

    The contingency table (at most k_true x k_pred rows) is checkpointed:
    every score and the expectation read it several times.
    """
    cont = cut_lineage(contingency(df, label, cluster))  # written once: the concurrent scalar subqueries below all read it
    return scores_from_contingency(cont, with_ami)


def scores_from_contingency(cont: DataFrame, with_ami: bool = True) -> DataFrame:
    """K7-K11 from a (label, cluster, n) contingency table."""
    st = contingency_stats(cont)
    out = st.select(
        "n_total", "k_true", "k_pred", "mi", "h_true", "h_pred",
        _ari(st).alias("ari"), _fms().alias("fms"),
        F.when(F.col("h_true") != 0, F.col("mi") / F.col("h_true")).otherwise(F.lit(1.0))
         .alias("homogeneity"),
        F.when(F.col("h_pred") != 0, F.col("mi") / F.col("h_pred")).otherwise(F.lit(1.0))
         .alias("completeness"))
    if not with_ami:
        return out
    emi = expected_mutual_information(cont)
    j = zip_rows(out, emi)
    denom = (F.col("h_true") + F.col("h_pred")) / 2 - F.col("emi")
    denom = F.when(denom < 0, F.least(denom, F.lit(-EPS64))).otherwise(F.greatest(denom, F.lit(EPS64)))
    ami = F.when(((F.col("k_true") == 1) & (F.col("k_pred") == 1))
                 | ((F.col("k_true") == 0) & (F.col("k_pred") == 0)), F.lit(1.0)).otherwise(
        (F.col("mi") - F.col("emi")) / denom)
    return j.withColumn("ami", ami)


def cluster_ratios(pred: DataFrame, label: str = "label", cluster: str = "cluster",
                   embedding: str = "embedding") -> DataFrame:
    """K1 + K5: n_samples, encoding_dim, true/pred cluster counts, clustered ratios."""
    return pred.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.max(F.size(embedding)).cast("bigint").alias("encoding_dim"),
        F.countDistinct(label).alias("num_cluster_true"),
        F.countDistinct(F.when(F.col(cluster) >= 0, F.col(cluster))).alias("num_cluster_pred"),
        (F.count_if(F.col(cluster) >= 0) / F.count(F.lit(1))).alias("ratio_clustered"),
        (F.lit(1.0) - F.count_if(F.col(cluster) >= 0) / F.count(F.lit(1))).alias("ratio_unclustered"))


def score_sheet(pred: DataFrame, spaces: dict[str, DataFrame] | None = None,
                reduced_dim: int | None = None) -> DataFrame:
    """The live metric record as tall rows (metric, value).

    ``pred`` has (vec_id, label, cluster, embedding); ``spaces`` maps the
    name suffixes "", "-fit", "-og" to (vec_id, embedding) frames.  Spaces
    given as the same object are computed once and emitted under each name.
    Guards follow the live evaluation: ``_pred`` metrics need more than one
    predicted cluster (among >= 0) and fewer distinct labels than samples;
    ``_clus`` metrics need at least one clustered sample, and their geometry
    scores need 1 < k_pred < clustered rows.
    """
    spaces = spaces or {"": pred.select("vec_id", "embedding")}
    ratios = cluster_ratios(pred)
    guards = pred.agg(F.countDistinct("cluster").alias("k_all"),
                      F.count(F.lit(1)).alias("n_all"),
                      F.count_if(F.col("cluster") >= 0).alias("n_clus"))
    cont = cut_lineage(contingency(pred))  # one small table feeds both the full and the clustered-only scores
    full = scores_from_contingency(cont).select(*[F.col(c).alias(c + "@full") for c in
                                                  ("ami", "ari", "fms", "completeness", "homogeneity")])
    clus = scores_from_contingency(cont.where("cluster >= 0")).select(
        *[F.col(c).alias(c + "@clus") for c in ("ami", "ari", "fms", "completeness", "homogeneity")])
    parts = [ratios, guards, full, clus]
    # distinct spaces -> one wide frame (vec_id, label, cluster, v0, v1, ...)
    tags, cols, base = {}, {}, pred.select("vec_id", "label", "cluster")
    for suffix, space in spaces.items():
        if id(space) not in tags:
            tag = f"s{len(tags)}"
            tags[id(space)] = tag
            base = base.join(space.select("vec_id", F.col("embedding").alias(tag)), "vec_id")
            cols[tag] = tag
    base = cut_lineage(base)  # read by the two geometry passes
    views = [("true", F.col("label"), None), ("pred", F.col("cluster"), None),
             ("pred_clus", F.col("cluster"), F.col("cluster") >= 0)]
    geo = geometry_scores(base, views, cols)
    geo_names = {suffix: tags[id(space)] for suffix, space in spaces.items()}
    wide_geo = []
    for tag in cols:
        for lab in ("true", "pred", "pred_clus"):
            hit = (F.col("space") == tag) & (F.col("labelling") == lab)
            wide_geo += [F.max(F.when(hit, F.col("chs"))).alias(f"chs@{tag}@{lab}"),
                         F.max(F.when(hit, F.col("dbs"))).alias(f"dbs@{tag}@{lab}")]
    parts.append(geo.agg(*wide_geo))  # one row: every (space, labelling) score
    wide = zip_rows(*parts)
    k_pred, n_clus = F.col("num_cluster_pred"), F.col("n_clus")
    g_pred = (k_pred > 1) & (F.col("k_all") < F.col("n_all"))
    g_clus = F.col("ratio_clustered") > 0
    g_clus_geo = g_clus & (k_pred > 1) & (k_pred < n_clus)
    rows = [("n_samples", F.col("n_samples"), None), ("encoding_dim", F.col("encoding_dim"), None),
            ("reduced_dim", F.lit(reduced_dim) if reduced_dim is not None else F.col("encoding_dim"), None),
            ("num_cluster_true", F.col("num_cluster_true"), None),
            ("num_cluster_pred", F.col("num_cluster_pred"), None),
            ("ratio_clustered", F.col("ratio_clustered"), None),
            ("ratio_unclustered", F.col("ratio_unclustered"), None),
            ("AMI", F.col("ami@full"), None), ("ARI", F.col("ari@full"), None),
            ("FMS", F.col("fms@full"), None), ("completeness", F.col("completeness@full"), None),
            ("homogeneity", F.col("homogeneity@full"), None)]
    for lab in ("true",):
        for m in ("CHS", "DBS"):
            for suffix, tag in geo_names.items():
                rows.append((f"{m}{suffix}_{lab}", F.col(f"{m.lower()}@{tag}@{lab}"), None))
    for m in ("CHS", "DBS"):
        for suffix, tag in geo_names.items():
            rows.append((f"{m}{suffix}_pred", F.col(f"{m.lower()}@{tag}@pred"), g_pred))
    for nm, c in (("AMI", "ami"), ("ARI", "ari"), ("FMS", "fms"), ("completeness", "completeness"),
                  ("homogeneity", "homogeneity")):
        rows.append((f"{nm}_clus", F.col(f"{c}@clus"), g_clus))
    for m in ("CHS", "DBS"):
        for suffix, tag in geo_names.items():
            rows.append((f"{m}{suffix}_pred_clus", F.col(f"{m.lower()}@{tag}@pred_clus"), g_clus_geo))
    tall = wide.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), val.cast("double").alias("value"),
                 (guard if guard is not None else F.lit(True)).alias("keep"))
        for name, val, guard in rows])).alias("r")).select("r.*")
    return tall.where("keep").drop("keep")


CENTROID_NUMBERS = 4_000_000  # numbers (32 MB) up to which the centroid table goes to the tasks; counted first
SALT_ROWS = 100_000  # beyond it: points of one cluster for each join key


def _group_sums(groups: list[tuple[str, str, str, str | None]]):
    """Per batch and (group, key): count, sum of squared norms and vector sum, one row per dimension (-1: the norms)."""
    def run(batches):
        for pdf in batches:
            out = []
            for name, key, vec, keep in groups:
                part = pdf if keep is None else pdf[pdf[keep].to_numpy(dtype=bool)]
                part = part[part[key].notna()]
                if not len(part):
                    continue
                keys, at = np.unique(part[key].to_numpy().astype(np.int64), return_inverse=True)
                x = np.vstack(part[vec].to_numpy())
                s = np.zeros((len(keys), x.shape[1] + 1))
                np.add.at(s[:, 1:], at, x)
                np.add.at(s[:, 0], at, (x * x).sum(1))
                cnt = np.bincount(at, minlength=len(keys))
                d = s.shape[1]
                out.append(pd.DataFrame({"g": name, "key": np.repeat(keys, d), "dim": np.tile(np.arange(-1, d - 1), len(keys)),
                                         "s": s.ravel(), "cnt": np.repeat(cnt, d)}))
            if out:
                yield pd.concat(out, ignore_index=True)
    return run


def _db_kernel(lt: pd.DataFrame, rt: pd.DataFrame, same: bool) -> pd.DataFrame:
    """Largest (s_i + s_j) / d_ij and largest d_ij of every cluster within one block pair."""
    xl, xr = np.vstack(lt["centroid"].to_numpy()), np.vstack(rt["centroid"].to_numpy())
    d = np.empty((len(xl), len(xr)))
    for a in range(0, len(xl), 64):
        diff = xl[a:a + 64, None, :] - xr[None, :, :]
        d[a:a + 64] = np.sqrt((diff * diff).sum(-1))
    r = np.divide(lt["s"].to_numpy()[:, None] + rt["s"].to_numpy()[None, :], d, out=np.zeros_like(d), where=d != 0)
    if same:
        np.fill_diagonal(r, -1.0)
        np.fill_diagonal(d, -1.0)
    sides = [(lt, r.max(1), d.max(1))] + ([] if same else [(rt, r.max(0), d.max(0))])
    out = pd.concat([pd.DataFrame({"g": t["g"].to_numpy(), "key": t["id"].to_numpy(), "r": rr, "md": dd}) for t, rr, dd in sides], ignore_index=True)
    return out[out["r"] >= 0]


def _centroid_distances(groups: list[tuple[str, str, str, str | None]], cents: pd.DataFrame):
    """Per batch and (group, key): summed distance of the points to their centroid and their number.  The rows stay where they are, unexploded."""
    table = {}
    for g, part in cents.groupby("g"):
        part = part.sort_values("key")
        table[g] = part["key"].to_numpy(), np.vstack(part["centroid"].to_numpy())

    def run(batches):
        for pdf in batches:
            out, stacked = [], {}
            for name, key, vec, keep in groups:
                on = pdf[key].notna().to_numpy() if keep is None else pdf[key].notna().to_numpy() & pdf[keep].to_numpy(dtype=bool)
                if not on.any():
                    continue
                if vec not in stacked:
                    stacked[vec] = np.vstack(pdf[vec].to_numpy())
                keys, c = table[name]
                at = np.searchsorted(keys, pdf[key].to_numpy(dtype=float)[on].astype(np.int64))
                diff = stacked[vec][on] - c[at]
                d = np.sqrt((diff * diff).sum(1))
                cnt = np.bincount(at, minlength=len(keys))
                some = np.flatnonzero(cnt)
                out.append(pd.DataFrame({"g": name, "key": keys[some], "t": np.bincount(at, d, len(keys))[some], "c": cnt[some]}))
            if out:
                yield pd.concat(out, ignore_index=True)
    return run


def _joined_distances(named: DataFrame, groups: list, cents: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same by a join, for centroid tables beyond the bound: one group at a time, the points of a cluster dealt over as many keys as its counted size needs."""
    out = None
    salted = cents.join(sizes, ["g", "key"]).withColumn("salts", F.ceil(F.col("cnt") / SALT_ROWS).cast("int"))
    for g, key, vec, keep in groups:
        c = salted.where(F.col("g") == g)
        points = named.where(F.col(key).isNotNull() & (F.lit(True) if keep is None else F.col(keep))).select(F.col(key).alias("key"), F.col(vec).alias("x"), F.xxhash64("vec_id").alias("_h"))
        # only clusters with several salts need the size on the points' side, and they are few: at most rows / SALT_ROWS
        big = F.broadcast(c.where("salts > 1").select("key", "salts"))
        points = points.join(big, "key", "left").withColumn("salt", F.pmod("_h", F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        part = points.join(c.select("key", "centroid", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), ["key", "salt"])
        part = part.groupBy("key", "salt").agg(F.sum(V.euclidean("x", "centroid")).alias("t"), F.count(F.lit(1)).alias("c")).select(F.lit(g).alias("g"), "key", "t", "c")
        out = part if out is None else out.unionByName(part)
    return out


def geometry_scores(df: DataFrame, views: list, spaces: dict[str, str], block_rows: int = 512) -> DataFrame:
    """K12 + K13 for several labellings and vector spaces in shared passes.

    ``views`` are (name, key column, row filter or None); ``spaces`` maps a space name to a vector column of
    ``df`` (with an id column ``vec_id``).  Every (space, labelling) is a group ``g``.  One pass sums the vectors per batch in numpy and emits
    k x d partial rows; a second one measures points against their centroid, in place with the centroid table at hand up to
    ``CENTROID_NUMBERS``, else by a join salted by counted size; centroid pairs run in block kernels that return one maximum per cluster.
    Output: (space, labelling, chs, dbs) - null where k <= 1 or k >= n.
    """
    named = df.select("vec_id", *spaces.values(), *[k.cast("long").alias(f"_key{i}") for i, (_, k, _) in enumerate(views)],
                      *[f.alias(f"_keep{i}") for i, (_, _, f) in enumerate(views) if f is not None])
    groups = [(f"{sp}|{name}", f"_key{i}", col, None if f is None else f"_keep{i}") for sp, col in spaces.items() for i, (name, _, f) in enumerate(views)]
    sums = named.mapInPandas(_group_sums(groups), "g string, key long, dim int, s double, cnt long")
    sums = cut_lineage(sums.groupBy("g", "key", "dim").agg(F.sum("s").alias("s"), F.sum("cnt").alias("cnt")))  # groups x k x d rows, read by three branches
    # Calinski-Harabasz from the sums alone.
    perk = sums.groupBy("g", "key").agg(
        F.sum(F.when(F.col("dim") >= 0, F.col("s") * F.col("s"))).alias("sk2"),
        F.max("cnt").alias("nk"), F.sum(F.when(F.col("dim") == -1, F.col("s"))).alias("xx"))
    per_g = perk.groupBy("g").agg(F.sum(F.col("sk2") / F.col("nk")).alias("b_term"),
                                  F.count(F.lit(1)).alias("k"), F.sum("nk").alias("n"),
                                  F.sum("xx").alias("xx"))
    s2 = (sums.where(F.col("dim") >= 0).groupBy("g", "dim").agg(F.sum("s").alias("S"))
          .groupBy("g").agg(F.sum(F.col("S") * F.col("S")).alias("s2")))
    ch = per_g.join(s2, "g")
    extra = F.col("b_term") - F.col("s2") / F.col("n")
    intra = F.col("xx") - F.col("b_term")
    kd, nd = F.col("k").cast("double"), F.col("n").cast("double")
    # guards first: CASE WHEN is lazy, so no division runs for k <= 1 or k >= n
    chs = (F.when((F.col("k") <= 1) | (F.col("k") >= F.col("n")), F.lit(None).cast("double"))
           .when(intra == 0, F.lit(1.0)).otherwise(extra * (nd - kd) / (intra * (kd - 1))))
    ch = ch.select("g", "k", "n", chs.alias("chs"))
    # Davies-Bouldin: centroids, mean distance to own centroid, centroid pairs.
    cents = (sums.where(F.col("dim") >= 0).groupBy("g", "key")
             .agg(F.array_sort(F.collect_list(F.struct("dim", (F.col("s") / F.col("cnt")).alias("m"))))
                  .alias("_c"))
             .select("g", "key", F.col("_c.m").alias("centroid")))
    if sums.count() <= CENTROID_NUMBERS:
        dist = named.mapInPandas(_centroid_distances(groups, cents.toPandas()), "g string, key long, t double, c long")
    else:
        dist = _joined_distances(named, groups, cents, sums.groupBy("g", "key").agg(F.max("cnt").alias("cnt")))
    intra_d = dist.groupBy("g", "key").agg((F.sum("t") / F.sum("c")).alias("s"))
    ci = cut_lineage(cents.join(intra_d, ["g", "key"]))
    max_k = max(1, ci.groupBy("g").count().agg(F.max("count")).first()[0] or 1)
    best = block_apply(ci, "key", ["centroid", "s"], _db_kernel, "g string, key long, r double, md double", block_rows, n=max_k, group="g")
    best = best.groupBy("g", "key").agg(F.max("r").alias("r"), F.max("md").alias("md"))
    db = (ci.select("g", "key", "s").join(best, ["g", "key"], "left").groupBy("g")
          .agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("dbs_raw"), F.max(F.abs("s")).alias("max_s"),
               F.max("md").alias("max_d")))
    out = ch.join(db, "g")
    undefined = (F.col("k") <= 1) | (F.col("k") >= F.col("n"))
    dbs = F.when(undefined, F.lit(None).cast("double")).when(
        (F.col("max_s") <= 1e-8) | (F.coalesce(F.col("max_d"), F.lit(0.0)) <= 1e-8), F.lit(0.0)) \
        .otherwise(F.col("dbs_raw"))
    parts = F.split("g", "\\|")
    return out.select(parts[0].alias("space"), parts[1].alias("labelling"),
                      F.when(undefined, F.lit(None).cast("double")).otherwise(F.col("chs")).alias("chs"),
                      dbs.alias("dbs"))

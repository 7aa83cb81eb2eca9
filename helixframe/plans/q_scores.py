"""Cluster-score plans (K5-K14) over the embeddings table and its predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import scores as S
from helixframe.operators.common import r6
from helixframe.plans.registry import query
from helixframe.plans.sqlfix import EMB, EMB17, PRED_EXPR
from helixframe.sources import fixtures as FX


def _pred(spark, sf, clustered_only=False, structured=False):
    base = FX.clustered_embeddings(spark, sf) if structured else FX.embedding_set(spark, sf)
    p = FX.predictions(spark, sf, base)
    return p.where("cluster >= 0") if clustered_only else p


def _pred_sql(clustered_only=False, structured=False):
    src = EMB17 if structured else EMB
    where = "WHERE cluster >= 0" if clustered_only else ""
    return f"SELECT * FROM (SELECT vec_id, embedding, label, {PRED_EXPR} AS cluster FROM ({src})) {where}"


def contingency_scores_sql(src: str) -> str:
    """All five pair-counting scores, written the direct way (cells joined to marginals)."""
    return f"""
    WITH p AS ({src}),
    cont AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM p GROUP BY label, cluster),
    a AS (SELECT label, sum(n) AS a FROM cont GROUP BY label),
    b AS (SELECT cluster, sum(n) AS b FROM cont GROUP BY cluster),
    tot AS (SELECT sum(n) AS N, (SELECT count(*) FROM a) AS ka, (SELECT count(*) FROM b) AS kb FROM cont),
    mi AS (SELECT CASE WHEN max(t.ka) <= 1 OR max(t.kb) <= 1 THEN 0.0
                  ELSE greatest(sum(c.n / t.N * ln(t.N * c.n / (a.a * b.b))), 0.0) END AS mi
           FROM cont c JOIN a USING (label) JOIN b USING (cluster) CROSS JOIN tot t),
    ent AS (SELECT (SELECT -sum(a / t.N * ln(a / t.N)) FROM a) AS h_true,
                   (SELECT -sum(b / t.N * ln(b / t.N)) FROM b) AS h_pred FROM tot t),
    sq AS (SELECT (SELECT sum(n * n) FROM cont) AS s_c, (SELECT sum(a * a) FROM a) AS s_a,
                  (SELECT sum(b * b) FROM b) AS s_b),
    emi AS (SELECT coalesce(sum(nij / N * ln(N * nij / (aa * bb)) * exp(
                lgamma(aa + 1) + lgamma(bb + 1) + lgamma(N - aa + 1) + lgamma(N - bb + 1)
                - lgamma(N + 1) - lgamma(nij + 1) - lgamma(aa - nij + 1) - lgamma(bb - nij + 1)
                - lgamma(N - aa - bb + nij + 1))), 0.0) AS emi
            FROM (SELECT a.a AS aa, b.b AS bb, t.N,
                         unnest(range(greatest(1, a.a + b.b - t.N)::BIGINT,
                                      least(a.a, b.b)::BIGINT + 1))::DOUBLE AS nij
                  FROM a CROSS JOIN b CROSS JOIN tot t)),
    pc AS (SELECT s_c - N AS tp, s_b - s_c AS fp, s_a - s_c AS fn,
                  N * N - (s_b - s_c) - (s_a - s_c) - s_c AS tn, s_a - N AS qk, s_b - N AS pk, N
           FROM sq CROSS JOIN tot)
    SELECT
      CASE WHEN fn = 0 AND fp = 0 THEN 1.0
           ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari,
      CASE WHEN tp <> 0 THEN sqrt(tp / pk) * sqrt(tp / qk) ELSE 0.0 END AS fms,
      CASE WHEN h_true <> 0 THEN mi / h_true ELSE 1.0 END AS homogeneity,
      CASE WHEN h_pred <> 0 THEN mi / h_pred ELSE 1.0 END AS completeness,
      CASE WHEN ka = 1 AND kb = 1 THEN 1.0
           ELSE (mi - emi) / CASE WHEN (h_true + h_pred) / 2 - emi < 0
                                  THEN least((h_true + h_pred) / 2 - emi, -2.220446049250313e-16)
                                  ELSE greatest((h_true + h_pred) / 2 - emi, 2.220446049250313e-16) END
      END AS ami
    FROM pc CROSS JOIN mi CROSS JOIN ent CROSS JOIN emi CROSS JOIN tot"""


def _two_sets_sql(metric: str) -> str:
    full = contingency_scores_sql(_pred_sql())
    clus = contingency_scores_sql(_pred_sql(clustered_only=True))
    return (f"SELECT round(f.{metric}, 6) + 0.0 AS {metric}, round(c.{metric}, 6) + 0.0 AS {metric}_clus "
            f"FROM ({full}) f CROSS JOIN ({clus}) c")


def _two_sets(spark, sf, metric):
    full = S.pair_scores(_pred(spark, sf), with_ami=(metric == "ami"))
    clus = S.pair_scores(_pred(spark, sf, clustered_only=True), with_ami=(metric == "ami"))
    from helixframe.operators.common import zip_rows
    return zip_rows(full.select(r6(metric).alias(metric)),
                    clus.select(r6(metric).alias(metric + "_clus")))


for _m, _id in [("ami", "k7"), ("ari", "k8"), ("fms", "k9"), ("completeness", "k10"),
                ("homogeneity", "k11")]:
    query(f"{_id}_{_m}", _two_sets_sql(_m))(
        (lambda m: lambda spark, sf: _two_sets(spark, sf, m))(_m))


@query("k6_contingency", f"""
SELECT label, cluster, count(*) AS n FROM ({_pred_sql()}) GROUP BY label, cluster""")
def k6_contingency(spark, sf):
    return S.contingency(_pred(spark, sf))


@query("k5_cluster_ratios", f"""
SELECT count(*) AS n_samples, max(len(embedding))::BIGINT AS encoding_dim,
       count(DISTINCT label) AS num_cluster_true,
       count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS num_cluster_pred,
       round(count(*) FILTER (WHERE cluster >= 0) / count(*)::DOUBLE, 6) + 0.0 AS ratio_clustered,
       round(1 - count(*) FILTER (WHERE cluster >= 0) / count(*)::DOUBLE, 6) + 0.0 AS ratio_unclustered
FROM ({_pred_sql()})""")
def k5_cluster_ratios(spark, sf):
    r = S.cluster_ratios(_pred(spark, sf))
    return r.select("n_samples", "encoding_dim", "num_cluster_true", "num_cluster_pred",
                    r6("ratio_clustered").alias("ratio_clustered"),
                    r6("ratio_unclustered").alias("ratio_unclustered"))


def ch_sql(src: str) -> str:
    return f"""
    WITH p AS ({src}),
    d AS (SELECT cluster, i, x FROM (SELECT cluster, unnest(embedding) AS x,
                                            unnest(range(len(embedding))) AS i FROM p)),
    cm AS (SELECT cluster, i, avg(x) AS m, count(*) AS nk FROM d GROUP BY cluster, i),
    gm AS (SELECT i, avg(x) AS m FROM d GROUP BY i),
    extra AS (SELECT sum(cm.nk * (cm.m - gm.m) * (cm.m - gm.m)) AS e FROM cm JOIN gm USING (i)),
    intra AS (SELECT sum((d.x - cm.m) * (d.x - cm.m)) AS w FROM d JOIN cm USING (cluster, i)),
    kn AS (SELECT count(DISTINCT cluster)::DOUBLE AS k, count(*)::DOUBLE AS n FROM p)
    SELECT CASE WHEN k <= 1 OR k >= n THEN NULL WHEN w = 0 THEN 1.0
                ELSE e * (n - k) / (w * (k - 1)) END AS chs
    FROM extra, intra, kn"""


def db_sql(src: str) -> str:
    return f"""
    WITH p AS ({src}),
    d AS (SELECT vec_id, cluster, i, x FROM (SELECT vec_id, cluster, unnest(embedding) AS x,
                                                    unnest(range(len(embedding))) AS i FROM p)),
    cm AS (SELECT cluster, i, avg(x) AS m FROM d GROUP BY cluster, i),
    dist AS (SELECT d.vec_id, d.cluster, sqrt(sum((d.x - cm.m) * (d.x - cm.m))) AS dd
             FROM d JOIN cm USING (cluster, i) GROUP BY d.vec_id, d.cluster),
    s AS (SELECT cluster, avg(dd) AS s FROM dist GROUP BY cluster),
    cc AS (SELECT a.cluster AS ca, b.cluster AS cb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist
           FROM cm a JOIN cm b ON a.i = b.i AND a.cluster <> b.cluster GROUP BY a.cluster, b.cluster),
    r AS (SELECT cc.ca, max(CASE WHEN cc.dist = 0 THEN 0.0 ELSE (sa.s + sb.s) / cc.dist END) AS r
          FROM cc JOIN s sa ON sa.cluster = cc.ca JOIN s sb ON sb.cluster = cc.cb GROUP BY cc.ca),
    kn AS (SELECT count(DISTINCT cluster) AS k, count(*) AS n FROM p)
    SELECT CASE WHEN k <= 1 OR k >= n THEN NULL
                WHEN (SELECT max(abs(s)) FROM s) <= 1e-8
                  OR coalesce((SELECT max(dist) FROM cc), 0) <= 1e-8 THEN 0.0
                ELSE (SELECT sum(coalesce(r.r, 0.0)) FROM s LEFT JOIN r ON r.ca = s.cluster)
                     / (SELECT count(*) FROM s) END AS dbs
    FROM kn"""


_LABELLINGS = [("true", "label", False), ("pred", "cluster", False), ("pred_clus", "cluster", True)]


def _geometry_sql(fn) -> str:
    parts = []
    for name, col, clus in _LABELLINGS:
        src = (f"SELECT vec_id, embedding, {col} AS cluster FROM "
               f"({_pred_sql(clustered_only=clus, structured=True)})")
        inner = fn(src)
        metric = "chs" if fn is ch_sql else "dbs"
        parts.append(f"SELECT '{name}' AS labelling, round({metric}, 6) + 0.0 AS {metric} FROM ({inner})")
    return " UNION ALL ".join(parts)


def _geometry(spark, sf, metric):
    """All three labellings in the shared single-pass geometry operator."""
    p = _pred(spark, sf, structured=True)
    views = [("true", F.col("label"), None), ("pred", F.col("cluster"), None),
             ("pred_clus", F.col("cluster"), F.col("cluster") >= 0)]
    geo = S.geometry_scores(p, views, {"og": "embedding"})
    return geo.select("labelling", r6(metric).alias(metric))


@query("k12_calinski_harabasz", _geometry_sql(ch_sql))
def k12(spark, sf):
    return _geometry(spark, sf, "chs")


@query("k13_davies_bouldin", _geometry_sql(db_sql))
def k13(spark, sf):
    return _geometry(spark, sf, "dbs")


# Three different spaces that SQL can build too: the leading dimensions of the vectors, by name suffix.
SPACES = {"": 50, "-fit": 32, "-og": 64}


def score_sheet_sql() -> str:
    full = contingency_scores_sql(_pred_sql(structured=True))
    clus = contingency_scores_sql(_pred_sql(clustered_only=True, structured=True))
    geo = {}
    for name, col, only in _LABELLINGS:
        for suffix, dims in SPACES.items():
            src = (f"SELECT vec_id, embedding[1:{dims}] AS embedding, {col} AS cluster FROM "
                   f"({_pred_sql(clustered_only=only, structured=True)})")
            geo[("CHS", suffix, name)] = f"(SELECT chs FROM ({ch_sql(src)}))"
            geo[("DBS", suffix, name)] = f"(SELECT dbs FROM ({db_sql(src)}))"
    base = f"SELECT * FROM ({_pred_sql(structured=True)})"
    g = f"""(SELECT count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS kp,
                    count(DISTINCT cluster) AS k_all, count(*) AS n_all,
                    count(*) FILTER (WHERE cluster >= 0) AS n_clus FROM ({base}))"""
    rows = [
        ("n_samples", f"(SELECT count(*) FROM ({base}))", "TRUE"),
        ("encoding_dim", f"(SELECT max(len(embedding)) FROM ({base}))", "TRUE"),
        ("reduced_dim", str(SPACES[""]), "TRUE"),
        ("num_cluster_true", f"(SELECT count(DISTINCT label) FROM ({base}))", "TRUE"),
        ("num_cluster_pred", "(SELECT kp FROM g)", "TRUE"),
        ("ratio_clustered", "(SELECT n_clus / n_all::DOUBLE FROM g)", "TRUE"),
        ("ratio_unclustered", "(SELECT 1 - n_clus / n_all::DOUBLE FROM g)", "TRUE"),
    ]
    for nm, c in (("AMI", "ami"), ("ARI", "ari"), ("FMS", "fms"), ("completeness", "completeness"),
                  ("homogeneity", "homogeneity")):
        rows.append((nm, f"(SELECT {c} FROM full_s)", "TRUE"))
    for m in ("CHS", "DBS"):
        for suffix in SPACES:
            rows.append((f"{m}{suffix}_true", geo[(m, suffix, "true")], "TRUE"))
    gp = "(SELECT kp > 1 AND k_all < n_all FROM g)"
    for m in ("CHS", "DBS"):
        for suffix in SPACES:
            rows.append((f"{m}{suffix}_pred", geo[(m, suffix, "pred")], gp))
    gc = "(SELECT n_clus > 0 FROM g)"
    for nm, c in (("AMI", "ami"), ("ARI", "ari"), ("FMS", "fms"), ("completeness", "completeness"),
                  ("homogeneity", "homogeneity")):
        rows.append((f"{nm}_clus", f"(SELECT {c} FROM clus_s)", gc))
    gcg = "(SELECT n_clus > 0 AND kp > 1 AND kp < n_clus FROM g)"
    for m in ("CHS", "DBS"):
        for suffix in SPACES:
            rows.append((f"{m}{suffix}_pred_clus", geo[(m, suffix, "pred_clus")], gcg))
    body = " UNION ALL ".join(
        f"SELECT '{n}' AS metric, round(({v})::DOUBLE, 6) + 0.0 AS value, {k} AS keep" for n, v, k in rows)
    return (f"WITH g AS {g}, full_s AS ({full}), clus_s AS ({clus}) "
            f"SELECT metric, value FROM ({body}) WHERE keep")


@query("k14_score_sheet", score_sheet_sql())
def k14_score_sheet(spark, sf):
    base = FX.clustered_embeddings(spark, sf)
    pred = FX.predictions(spark, sf, base)
    spaces = {suffix: base.select("vec_id", F.slice("embedding", 1, dims).alias("embedding")) for suffix, dims in SPACES.items()}
    sheet = S.score_sheet(pred, spaces, reduced_dim=SPACES[""])
    return sheet.select("metric", r6("value").alias("value"))

"""Clustering plans: kNN graph (K3), silhouette (K15), and the pyspark.ml
based reducers / clusterers / probe (K2, K4, K16-K18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import descent as DE
from helixframe.operators import graph as G
from helixframe.operators.common import r6, zip_rows
from helixframe.plans.registry import ORACLES, query
from helixframe.plans.sqlfix import EMB17, PRED_EXPR, sqdist_sql
from helixframe.session import cut_lineage
from helixframe.sources import fixtures as FX

KNN = 30


@query("k3_knn_graph", f"""
WITH e AS ({EMB17}),
d AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt({sqdist_sql('a.embedding', 'b.embedding')}) AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT src, dst, rank, round(dist, 6) + 0.0 AS dist FROM (
  SELECT src, dst, dist, (row_number() OVER (PARTITION BY src ORDER BY dist, dst))::INTEGER AS rank FROM d)
WHERE rank <= {KNN}""")
def k3_knn_graph(spark, sf):
    e = FX.clustered_embeddings(spark, sf)
    g = G.knn_graph(e, "vec_id", "embedding", KNN)
    return g.select("src", "dst", "rank", r6("dist").alias("dist"))


@query("k3_knn_descent", f"""
SELECT count(*) AS n_rows, count(*) * least({KNN}, count(*) - 1) AS n_edges, {KNN} AS k, TRUE AS full_lists, TRUE AS recall_reached FROM embeddings""")
def k3_knn_descent(spark, sf):
    """The graph by neighbour descent over all vectors; recall against the exact neighbours of every row whose id is divisible by 100."""
    e = FX.clustered_embeddings(spark, sf)
    g = cut_lineage(DE.knn_descent(e, "vec_id", "embedding", KNN))
    sizes = g.groupBy("src").agg(F.count(F.lit(1)).alias("m"))
    facts = sizes.agg(F.sum("m").alias("n_edges"), F.min("m").alias("least"))
    rec = DE.recall(g, e, "vec_id", "embedding", KNN)
    n = e.agg(F.count(F.lit(1)).alias("n_rows"))
    n_rows = F.col("n_rows")
    return zip_rows(n, facts, rec).select("n_rows", "n_edges", F.lit(KNN).alias("k"), (F.col("least") == F.least(F.lit(KNN), n_rows - 1)).alias("full_lists"),
                                          (F.col("recall") >= 0.9).alias("recall_reached"))


SPACES = {"": 50, "-fit": 32, "-og": 64}  # leading dimensions: three different spaces that SQL can build too
_LABELS = {"true": ("label", "TRUE"), "true_clus": ("label", "cluster >= 0"), "pred": ("cluster", "TRUE"), "pred_clus": ("cluster", "cluster >= 0")}


def _sil_sql() -> str:
    x = "list_transform(a.v, lambda t, i: abs(t - b.v[i]))"
    parts, rows = [f"e AS (SELECT vec_id, label, {PRED_EXPR} AS cluster, embedding FROM ({EMB17}))",
                   """g AS (SELECT count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS kp, count(DISTINCT cluster) AS ka, count(*) AS n,
                      count(*) FILTER (WHERE cluster >= 0) AS nc FROM e)"""], []
    for j, (suffix, dims) in enumerate(SPACES.items()):
        parts.append(f"""v{j} AS (SELECT vec_id, label, cluster, embedding[1:{dims}] AS v,
            list_transform(embedding[1:{dims}], lambda t: t / greatest(sqrt(list_dot_product(embedding[1:{dims}], embedding[1:{dims}])), 1e-12)) AS u FROM e)""")
        parts.append(f"""d{j} AS (SELECT a.vec_id AS src, a.label AS la, b.label AS lb, a.cluster AS ca, b.cluster AS cb,
            sqrt({sqdist_sql('a.v', 'b.v')}) AS euclidean, list_sum({x}) AS l1, list_max({x}) AS chebyshev, sqrt({sqdist_sql('a.u', 'b.u')}) AS arccos
            FROM v{j} a JOIN v{j} b ON a.vec_id <> b.vec_id)""")
        for name, (col, cond) in _LABELS.items():
            t, c1, c2 = f"{j}_{name}", "la" if col == "label" else "ca", "lb" if col == "label" else "cb"
            both = "TRUE" if cond == "TRUE" else "ca >= 0 AND cb >= 0"
            sums = ", ".join(f"sum({m}) AS {m}" for m in G.SIL_METRICS)
            parts.append(f"z{t} AS (SELECT {col} AS c, count(*) AS nc FROM e WHERE {cond} GROUP BY {col})")
            parts.append(f"s{t} AS (SELECT src, {c1} AS sc, {c2} AS dc, {sums} FROM d{j} WHERE {both} GROUP BY src, {c1}, {c2})")
            ab = ", ".join(f"max(CASE WHEN s.sc = s.dc THEN s.{m} / greatest(z.nc - 1, 1) END) AS a_{m}, min(CASE WHEN s.sc <> s.dc THEN s.{m} / z.nc END) AS b_{m}" for m in G.SIL_METRICS)
            parts.append(f"p{t} AS (SELECT s.src, {ab} FROM s{t} s JOIN z{t} z ON z.c = s.dc GROUP BY s.src)")
            keep = {"true": "TRUE", "true_clus": "nc > 0", "pred": "kp > 1 AND ka < n", "pred_clus": "kp > 1 AND ka < n AND nc > 0 AND kp < nc"}[name]
            for m in G.SIL_METRICS:
                val = f"CASE WHEN a_{m} IS NULL OR b_{m} IS NULL OR greatest(a_{m}, b_{m}) = 0 THEN 0.0 ELSE (b_{m} - a_{m}) / greatest(a_{m}, b_{m}) END"
                rows.append(f"SELECT 'silhouette{suffix}-{m}_{name}' AS metric, round(avg({val}), 6) + 0.0 AS value FROM p{t} WHERE (SELECT {keep} FROM g)")
    return f"WITH {', '.join(parts)} SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE value IS NOT NULL"


@query("k15_silhouette", _sil_sql())
def k15_silhouette(spark, sf):
    e = FX.predictions(spark, sf, FX.clustered_embeddings(spark, sf))
    spaces = {s: e.select("vec_id", F.slice("embedding", 1, d).alias("embedding")) for s, d in SPACES.items()}
    return G.silhouette_sheet(e, spaces).select("metric", r6("value").alias("value"))


# ------------------------------------------------ pyspark.ml based (rows only)
from helixframe.functions import vectors as V  # noqa: E402
from helixframe.operators import cluster as CL  # noqa: E402
from helixframe.operators import scores as S  # noqa: E402
from helixframe.operators import spectral as SP  # noqa: E402

REDUCED_DIM = 50


def _k_true(e):
    return e.agg(F.countDistinct("label")).first()[0]  # K1: a scalar


@query("k1_true_cluster_count", "SELECT count(DISTINCT label) AS num_cluster_true FROM embeddings")
def k1_true_cluster_count(spark, sf):
    return FX.embedding_set(spark, sf).agg(F.countDistinct("label").alias("num_cluster_true"))


@query("k2_pca_reduce")
def k2_pca_reduce(spark, sf):
    e = FX.clustered_embeddings(spark, sf)
    r, _ = CL.pca_reduce(e, "embedding", REDUCED_DIM)
    return r.select("vec_id", V.round_vec("reduced").alias("reduced"))


# The classes of F17 are far apart (1.5 in one dimension), so the minimum-variance cut at the true count is the label
# partition; clusters are numbered by their smallest id.
@query("k4_ward", """
WITH m AS (SELECT label, min(vec_id) AS root FROM embeddings GROUP BY label)
SELECT e.vec_id, (dense_rank() OVER (ORDER BY m.root) - 1)::INTEGER AS cluster FROM embeddings e JOIN m USING (label)""")
def k4_ward(spark, sf):
    e = FX.clustered_embeddings(spark, sf)
    return CL.ward(e, "vec_id", "embedding", _k_true(e))


@query("k16_kmeans")
def k16_kmeans(spark, sf):
    e = FX.clustered_embeddings(spark, sf)
    pred, facts = CL.kmeans(e, "vec_id", "embedding", _k_true(e), seed=0)
    sc = S.pair_scores(e.select("vec_id", "label").join(pred, "vec_id"))
    return sc.select(r6("ami").alias("ami"), r6("ari").alias("ari"),
                     F.lit(facts["n_iter"]).alias("n_iter"), F.lit(facts["converged"]).alias("converged"))


@query("k17_bisecting_kmeans")
def k17_bisecting_kmeans(spark, sf):
    e = FX.clustered_embeddings(spark, sf)
    pred, _ = CL.kmeans(e, "vec_id", "embedding", _k_true(e), seed=0, max_iter=20, bisecting=True)
    return pred


@query("k17_power_iteration")
def k17_power_iteration(spark, sf):
    e = FX.clustered_embeddings(spark, sf)
    g = G.knn_graph(e, "vec_id", "embedding", KNN)
    return CL.power_iteration(g, _k_true(e))


@query("k18_linear_probe")
def k18_linear_probe(spark, sf):
    e = FX.clustered_embeddings(spark, sf)
    return CL.linear_probe(e, "embedding", "label").select("split", r6("accuracy").alias("accuracy"), "n")


def flagship(spark, sf):
    """The live evaluation end to end: vectors -> PCA -> Ward at the true k -> score sheet."""
    og = FX.clustered_embeddings(spark, sf)
    k = _k_true(og)
    red, kk = CL.pca_reduce(og, "embedding", REDUCED_DIM)
    # The reduced space feeds a dozen aggregates: materialise it once.
    red = cut_lineage(red.select("vec_id", F.col("reduced").alias("embedding")))
    labels = CL.ward(red, "vec_id", "embedding", k)
    pred = og.select("vec_id", "label", "embedding").join(labels, "vec_id")
    sheet = S.score_sheet(pred.select("vec_id", "label", "cluster", "embedding"),
                          {"": red, "-fit": red, "-og": og.select("vec_id", "embedding")}, reduced_dim=kk)
    return sheet.select("metric", r6("value").alias("value"))


query("k14_flagship_pipeline")(flagship)


# ---------------------------------------------------------------- spectral (graph by neighbour descent)
SPECTRAL_DIMS, SPECTRAL_TOL = 9, 1e-6


# The classes of F17 are parts of the neighbour graph of their own, and each part gives one eigenvalue 0 of the Laplacian.
@query("k2_spectral_reduce", f"""
SELECT count(*) AS n_rows, least({SPECTRAL_DIMS}, count(*) - 1) AS dims, TRUE AS residual_reached, count(DISTINCT label) AS parts FROM embeddings""")
def k2_spectral_reduce(spark, sf):
    g = DE.knn_descent(FX.clustered_embeddings(spark, sf), "vec_id", "embedding", KNN)
    y, eig = SP.spectral_embedding(g, SPECTRAL_DIMS, SPECTRAL_TOL)
    return y.agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.size("reduced")).cast("bigint").alias("dims")).select(
        "n_rows", "dims", F.lit(bool(eig.residuals.max() <= SPECTRAL_TOL)).alias("residual_reached"), F.lit(int((eig.values > 1 - 1e-4).sum())).cast("bigint").alias("parts"))


@query("k17_spectral", ORACLES["k4_ward"])
def k17_spectral(spark, sf):
    e = FX.clustered_embeddings(spark, sf)
    g = DE.knn_descent(e, "vec_id", "embedding", KNN)
    return SP.spectral_clustering(g, _k_true(e), SPECTRAL_TOL).select(F.col("id").alias("vec_id"), "cluster")

"""Vector plans: pooling (E1-E6), projection (E5), similarity and distances
(E7-E13), the hashing scorer and encoder hook (E14, U1) and the masked-token
loss (C7)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from helixframe.functions import vectors as V
from helixframe.functions.hashing import uniform
from helixframe.operators import contrastive as C
from helixframe.operators import encode as EN
from helixframe.operators import pooling as PO
from helixframe.operators.common import r6
from helixframe.plans import q_contrastive
from helixframe.plans.q_encode import DOC_IDS, _doc_ids, _doc_tokens
from helixframe.plans.registry import query
from helixframe.plans.sqlfix import EMB_U, PAIRS, cos_sql, hash_u32, tokens_sql, trunc_sql, uniform as u_sql
from helixframe.sources import fixtures as FX

HID_SQL = """SELECT vec_id // 8 AS seq_id, layer::INTEGER AS layer, (vec_id % 8)::INTEGER AS pos,
  CASE WHEN vec_id % 8 < 1 + (vec_id // 8) % 8 THEN 1 ELSE 0 END AS mask,
  list_transform(embedding::DOUBLE[], lambda x: x * (layer + 1)) AS h
FROM embeddings, range(4) r(layer)"""
NL = 4


def rv(expr: str) -> str:
    return f"list_transform({expr}, lambda v: round(v, 6) + 0.0)"


def _pool_sql(layers: list[int]) -> str:
    ls = ", ".join(str(x) for x in layers)
    return f"""WITH x AS (SELECT seq_id, mask, unnest(h) AS x, unnest(range(len(h))) AS dim FROM ({HID_SQL}) WHERE layer IN ({ls})),
s AS (SELECT seq_id, dim, sum(mask * x) / sum(mask)::DOUBLE AS v FROM x GROUP BY seq_id, dim)
SELECT seq_id, {rv('list(v ORDER BY dim)')} AS pooled FROM s GROUP BY seq_id"""


def _hid(spark, sf):
    return FX.hidden_states(spark, sf)


@query("e1_pool_cls", f"SELECT seq_id, {rv('h')} AS pooled FROM ({HID_SQL}) WHERE layer = {NL - 1} AND pos = 0")
def e1_pool_cls(spark, sf):
    return PO.pool(_hid(spark, sf), "cls", NL).select("seq_id", V.round_vec("pooled").alias("pooled"))


for _name, _pooler, _layers in (("e2_pool_avg", "avg", [NL - 1]),
                                ("e3_pool_avg_first_last", "avg_first_last", [1, NL - 1]),
                                ("e4_pool_avg_top2", "avg_top2", [NL - 2, NL - 1])):
    query(_name, _pool_sql(_layers))(
        (lambda p: lambda spark, sf: PO.pool(_hid(spark, sf), p, NL).select(
            "seq_id", V.round_vec("pooled").alias("pooled")))(_pooler))


@query("e6_token_mean_max", f"""
WITH x AS (SELECT seq_id, unnest(h) AS x, unnest(range(len(h))) AS dim FROM ({HID_SQL}) WHERE layer = {NL - 1}),
s AS (SELECT seq_id, dim, avg(x) AS m, max(x) AS mx FROM x GROUP BY seq_id, dim)
SELECT seq_id, {rv('list(m ORDER BY dim)')} AS mean_pooled, {rv('list(mx ORDER BY dim)')} AS max_pooled
FROM s GROUP BY seq_id""")
def e6_token_mean_max(spark, sf):
    h = _hid(spark, sf)
    m = PO.token_pool(h, "mean", NL - 1).withColumnRenamed("pooled", "mean_pooled")
    x = PO.token_pool(h, "max", NL - 1).withColumnRenamed("pooled", "max_pooled")
    return m.join(x, "seq_id").select("seq_id", V.round_vec("mean_pooled").alias("mean_pooled"),
                                      V.round_vec("max_pooled").alias("max_pooled"))


D = 64
W_SEED, W_SCALE = 3, 0.25


@query("e5_mlp_head", f"""
WITH W AS (SELECT o, i, ({u_sql(str(W_SEED), "'w'", 'o', 'i')} - 0.5) * {W_SCALE} AS w FROM range({D}) t1(o), range({D}) t2(i)),
B AS (SELECT o, ({u_sql(str(W_SEED), "'b'", 'o')} - 0.5) * {W_SCALE} AS b FROM range({D}) t(o)),
X AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
P AS (SELECT vec_id, o, tanh(sum(x * w) + max(b)) AS v FROM X JOIN W USING (i) JOIN B USING (o) GROUP BY vec_id, o)
SELECT vec_id, {rv('list(v ORDER BY o)')} AS projected FROM P GROUP BY vec_id""")
def e5_mlp_head(spark, sf):
    W, b = PO.md5_weights(D, W_SEED, W_SCALE)
    e = FX.embedding_set(spark, sf).select("vec_id", "embedding")
    return PO.mlp_head(e, "embedding", W, b).select("vec_id", V.round_vec("projected").alias("projected"))


@query("e7_l2_normalize", f"SELECT vec_id, {rv('u')} AS normalized FROM ({EMB_U})")
def e7_l2_normalize(spark, sf):
    e = FX.embedding_set(spark, sf)
    return e.select("vec_id", V.round_vec(V.l2_normalize("embedding")).alias("normalized"))


TEMP = 0.05


@query("e8_scaled_cosine", f"SELECT idx, round({cos_sql('z1', 'z2')} / {TEMP}, 6) + 0.0 AS sim FROM ({PAIRS})")
def e8_scaled_cosine(spark, sf):
    p = FX.embedding_pairs(spark, sf)
    return p.select("idx", r6(V.cosine("z1", "z2") / F.lit(TEMP)).alias("sim"))


@query("e9_angular_similarity", f"""
SELECT idx, round((pi() / 2 - acos(least(greatest({cos_sql('z1', 'z2')}, -(1 - 1e-6)), 1 - 1e-6))) / {TEMP}, 6) + 0.0 AS angular
FROM ({PAIRS})""")
def e9_angular_similarity(spark, sf):
    p = FX.embedding_pairs(spark, sf)
    return p.select("idx", r6(V.angular_similarity("z1", "z2", TEMP)).alias("angular"))


_NPAIRS = f"""SELECT idx, list_transform(z1, lambda v: v / greatest(sqrt(list_dot_product(z1, z1)), 1e-12)) AS a,
  list_transform(z2, lambda v: v / greatest(sqrt(list_dot_product(z2, z2)), 1e-12)) AS b, z1, z2 FROM ({PAIRS})"""


@query("e10_regression_distance", f"SELECT idx, round(2 - 2 * list_dot_product(a, b), 6) + 0.0 AS loss FROM ({_NPAIRS})")
def e10_regression_distance(spark, sf):
    p = FX.embedding_pairs(spark, sf)
    return p.select("idx", r6(F.lit(2.0) - F.lit(2.0) * V.dot(V.l2_normalize("z1"), V.l2_normalize("z2")))
                    .alias("loss"))


def _d(expr):
    return f"round({expr}, 6) + 0.0"


_VAR_SQL = """(SELECT list(v ORDER BY i) FROM (SELECT i, var_samp(x) AS v FROM
  (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i))"""


@query("e11_distances", f"""
WITH p AS ({PAIRS}), vv AS (SELECT {_VAR_SQL} AS var)
SELECT idx,
  {_d("sqrt(list_sum(list_transform(z1, lambda v, i: (v - z2[i]) * (v - z2[i]))))")} AS euclidean,
  {_d("list_sum(list_transform(z1, lambda v, i: (v - z2[i]) * (v - z2[i])))")} AS sqeuclidean,
  {_d("list_sum(list_transform(z1, lambda v, i: abs(v - z2[i])))")} AS cityblock,
  {_d("list_max(list_transform(z1, lambda v, i: abs(v - z2[i])))")} AS chebyshev,
  {_d("pow(list_sum(list_transform(z1, lambda v, i: pow(abs(v - z2[i]), 3.0))), 1.0 / 3.0)")} AS minkowski3,
  {_d("1 - list_dot_product(z1, z2) / (sqrt(list_dot_product(z1, z1)) * sqrt(list_dot_product(z2, z2)))")} AS cosine,
  {_d("list_sum(list_transform(z1, lambda v, i: abs(v - z2[i]))) / list_sum(list_transform(z1, lambda v, i: abs(v + z2[i])))")} AS braycurtis,
  {_d("list_sum(list_transform(z1, lambda v, i: CASE WHEN abs(v) + abs(z2[i]) = 0 THEN 0.0 ELSE abs(v - z2[i]) / (abs(v) + abs(z2[i])) END))")} AS canberra,
  {_d("sqrt(list_sum(list_transform(z1, lambda v, i: pow(v / greatest(sqrt(list_dot_product(z1, z1)), 1e-12) - z2[i] / greatest(sqrt(list_dot_product(z2, z2)), 1e-12), 2))))")} AS arccos,
  {_d("sqrt(list_sum(list_transform(z1, lambda v, i: (v - z2[i]) * (v - z2[i]) / var[i])))")} AS seuclidean
FROM p, vv""")
def e11_distances(spark, sf):
    p = FX.embedding_pairs(spark, sf)
    e = FX.embedding_set(spark, sf)
    var = (e.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("v"))
           .agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("a")).select(F.col("a.v").alias("var")))
    p = p.withColumn("var", var.scalar())
    cols = {n: V.distance(n, "z1", "z2") for n in ("euclidean", "sqeuclidean", "cityblock", "chebyshev",
                                                   "cosine", "braycurtis", "canberra", "arccos")}
    cols["minkowski3"] = V.minkowski("z1", "z2", 3.0)
    cols["seuclidean"] = V.seuclidean("z1", "z2", "var")
    return p.select("idx", *[r6(c).alias(n) for n, c in cols.items()])


@query("e11_mahalanobis")
def e11_mahalanobis(spark, sf):
    """Mahalanobis distance of each pair; the d x d inverse covariance comes from a Gram aggregate."""
    e = FX.embedding_set(spark, sf)
    VI = PO.inverse_covariance(e, "embedding")
    return FX.embedding_pairs(spark, sf).select("idx", r6(PO.mahalanobis("z1", "z2", VI)).alias("mahalanobis"))


_STATS = """(SELECT list(m ORDER BY i) AS mean, list(sd ORDER BY i) AS std FROM (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM
  (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i))"""


@query("e12_prenormalise", f"""
WITH st AS {_STATS}, u AS ({EMB_U})
SELECT u.vec_id,
  {rv("list_transform(u.x, lambda v, i: (v - st.mean[i]) / st.std[i])")} AS zscore,
  {rv("list_transform(u.x, lambda v, i: (v - st.mean[i]) / (list_sum(st.std) / len(st.std)))")} AS avg_zscore,
  {rv("list_transform(u.u, lambda v: v * sqrt(len(u.u)))")} AS l2_corrected
FROM u, st""")
def e12_prenormalise(spark, sf):
    e = FX.embedding_set(spark, sf).select("vec_id", "embedding")
    z = PO.prenormalise(e, "embedding", "zscore").withColumnRenamed("embedding", "zscore")
    a = PO.prenormalise(e, "embedding", "avg_zscore").withColumnRenamed("embedding", "avg_zscore")
    c = PO.prenormalise(e, "embedding", "l2_corrected").withColumnRenamed("embedding", "l2_corrected")
    j = z.join(a, "vec_id").join(c, "vec_id")
    return j.select("vec_id", *[V.round_vec(n).alias(n) for n in ("zscore", "avg_zscore", "l2_corrected")])


@query("e13_dim_correction", f"SELECT vec_id, {rv('list_transform(embedding::DOUBLE[], lambda v: v / sqrt(len(embedding)))')} AS corrected FROM embeddings")
def e13_dim_correction(spark, sf):
    e = FX.embedding_set(spark, sf)
    return e.select("vec_id", V.round_vec(PO.dim_correct("embedding")).alias("corrected"))


HASH_SEED, HASH_DIM = 5, 64


@query("e14_hashed_embedding", f"""
WITH tok AS (SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents),
x AS (SELECT doc_id, h % {HASH_DIM} AS dim, CASE WHEN (h // {HASH_DIM}) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s
      FROM (SELECT doc_id, {hash_u32(str(HASH_SEED), 't')} AS h FROM (SELECT doc_id, unnest(tokens) AS t FROM tok))),
s AS (SELECT doc_id, dim, sum(s) AS v FROM x GROUP BY doc_id, dim),
dense AS (SELECT d.doc_id, list(coalesce(s.v, 0.0)::DOUBLE ORDER BY r.dim) AS e
          FROM tok d CROSS JOIN range({HASH_DIM}) r(dim) LEFT JOIN s ON s.doc_id = d.doc_id AND s.dim = r.dim
          GROUP BY d.doc_id)
SELECT doc_id, {rv("list_transform(e, lambda v: v / greatest(sqrt(list_dot_product(e, e)), 1e-12))")} AS embedding FROM dense""")
def e14_hashed_embedding(spark, sf):
    h = PO.hashed_embedding(_doc_tokens(spark, sf), "doc_id", "tokens", HASH_DIM, HASH_SEED)
    return h.select("doc_id", V.round_vec("embedding").alias("embedding"))


@query("u1_encoder_hook", f"""
WITH t AS (SELECT doc_id, {trunc_sql('ids')} AS t FROM {DOC_IDS})
SELECT doc_id, [len(t)::DOUBLE, round(list_sum(t) / len(t)::DOUBLE, 6) + 0.0, list_min(t)::DOUBLE, list_max(t)::DOUBLE] AS embedding FROM t""")
def u1_encoder_hook(spark, sf):
    """Encoded documents (T1-T3) through a user scorer in mapInPandas."""
    d = _doc_ids(spark, sf, head=126).select("doc_id", EN.truncate(F.col("ids")).alias("t"))
    enc = d.select("doc_id", EN.pad(F.col("t")).alias("input_ids"), EN.mask_of(F.col("t")).alias("attention_mask"))
    e = PO.embed_with(enc, PO.id_stats_scorer, "doc_id", 4, ["input_ids", "attention_mask"])
    return e.select("doc_id", V.round_vec("embedding").alias("embedding"))


MLM_VOCAB, MLM_SEED, MLM_RATE, MLM_WEIGHT = 16, 13, 0.15, 0.1


_MLM_SQL = f"""
WITH t AS (SELECT doc_id, {trunc_sql('ids')} AS t FROM {DOC_IDS}),
x AS (SELECT doc_id, unnest(t) AS id, unnest(range(len(t))) AS pos FROM t),
lab AS (SELECT doc_id, pos, CASE WHEN {u_sql(str(MLM_SEED), "'lab'", 'doc_id', 'pos')} < {MLM_RATE}
                                 THEN id % {MLM_VOCAB} ELSE -100 END AS label FROM x),
lg AS (SELECT l.doc_id, l.pos, l.label, r.v AS vocab,
              ({u_sql(str(MLM_SEED), "'logit'", 'l.doc_id', 'l.pos', 'r.v')} - 0.5) * 4.0 AS logit
       FROM lab l, range({MLM_VOCAB}) r(v) WHERE l.label <> -100),
per AS (SELECT doc_id, pos, max(logit) + ln(sum(exp(logit - mx))) - max(CASE WHEN vocab = label THEN logit END) AS nll
        FROM (SELECT *, max(logit) OVER (PARTITION BY doc_id, pos) AS mx FROM lg) GROUP BY doc_id, pos)"""


@query("c7_mlm_loss", f"{_MLM_SQL} SELECT round(avg(nll), 6) + 0.0 AS mlm_loss FROM per")
def c7_mlm_loss(spark, sf):
    d = _doc_ids(spark, sf, head=126).select("doc_id", EN.truncate(F.col("ids")).alias("t"))
    x = d.select(F.col("doc_id").alias("seq"), F.posexplode("t").alias("pos", "id"))
    x = x.withColumn("label", F.when(uniform(F.lit(MLM_SEED), F.lit("lab"), F.col("seq"), F.col("pos")) < MLM_RATE,
                                     (F.col("id") % MLM_VOCAB).cast("int")).otherwise(F.lit(-100)))
    lg = x.withColumn("vocab", F.explode(F.sequence(F.lit(0), F.lit(MLM_VOCAB - 1)))).withColumn(
        "logit", (uniform(F.lit(MLM_SEED), F.lit("logit"), F.col("seq"), F.col("pos"), F.col("vocab")) - 0.5) * 4.0)
    return C.masked_lm_loss(lg).select(r6("mlm_loss").alias("mlm_loss"))


@query("c7_combined_loss", f"""
{_MLM_SQL},
con AS ({q_contrastive.LOSS_BY_BATCH_SQL})
SELECT batch, round(loss + {MLM_WEIGHT} * (SELECT round(avg(nll), 6) FROM per), 6) + 0.0 AS loss FROM con""")
def c7_combined_loss(spark, sf):
    """The training loss with the masked-token term: contrastive loss + weight * MLM loss."""
    loss = C.batch_losses(q_contrastive.all_logits(spark, sf))
    return C.with_masked_lm(loss, c7_mlm_loss(spark, sf), MLM_WEIGHT).select("batch", r6("loss").alias("loss"))

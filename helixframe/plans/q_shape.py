"""Ragged blocks (T7-T11), vector noise (T17) and embedding-set shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import vectors as V
from helixframe.operators import encode as EN
from helixframe.operators import ragged as RG
from helixframe.operators import shape as SH
from helixframe.operators.indexing import dense_index
from helixframe.operators.noise import gaussian_noise
from helixframe.plans.q_encode import DOC_IDS, _doc_ids
from helixframe.plans.registry import query
from helixframe.plans.sqlfix import EMB, PRED_EXPR, mask_sql, pad_sql, trunc_sql
from helixframe.sources import fixtures as FX

L, BATCH = 128, 64

PADDED_SQL = f"""SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch,
  ((row_number() OVER (ORDER BY doc_id) - 1) % {BATCH})::INTEGER AS seq,
  {pad_sql(trunc_sql('ids'))} AS input_ids, {mask_sql(trunc_sql('ids'))} AS attention_mask FROM {DOC_IDS}"""


def _padded(spark, sf):
    d = _doc_ids(spark, sf, head=126).select("doc_id", EN.truncate(F.col("ids")).alias("t"))
    d = dense_index(d, ["doc_id"])
    return d.select("doc_id", (F.col("idx") / BATCH).cast("bigint").alias("batch"),
                    (F.col("idx") % BATCH).cast("int").alias("seq"),
                    EN.pad(F.col("t")).alias("input_ids"), EN.mask_of(F.col("t")).alias("attention_mask"))


@query("t7_ragged_pack", f"""
WITH p AS ({PADDED_SQL}), s AS (SELECT doc_id, batch, seq, list_sum(attention_mask)::INTEGER AS seqlen FROM p)
SELECT doc_id, batch, seq, seqlen,
  coalesce(sum(seqlen) OVER (PARTITION BY batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cu_start,
  max(seqlen) OVER (PARTITION BY batch) AS max_seqlen FROM s""")
def t7_ragged_pack(spark, sf):
    return RG.pack(_padded(spark, sf), "doc_id", "batch", "seq")


@query("t8_unpad_values", f"""
WITH p AS ({PADDED_SQL}),
z AS (SELECT doc_id, seq, unnest(input_ids) AS v, unnest(attention_mask) AS m, unnest(range({L})) AS pos FROM p)
SELECT doc_id, (seq * {L} + pos)::BIGINT AS flat, v AS value FROM z WHERE m = 1""")
def t8_unpad_values(spark, sf):
    return RG.unpad(_padded(spark, sf), "doc_id", "seq", L)


@query("t9_repad", f"SELECT doc_id, {pad_sql(trunc_sql('ids'))} AS input_ids FROM {DOC_IDS}")
def t9_repad(spark, sf):
    """pack then re-pad: must give back the padded ids (identity on the real cells)."""
    p = _padded(spark, sf)
    packed = RG.unpad(p, "doc_id", "seq", L)
    return RG.repad(packed, p.select("doc_id", "seq"), "doc_id", "seq", L)


@query("t10_gather_rows", """
WITH n AS (SELECT count(*) AS n FROM embeddings),
ix AS (SELECT r.p, (r.p * 7) % (n.n // 2) AS idx FROM n, range((SELECT n FROM n)) r(p))
SELECT ix.p, e.vec_id, e.label FROM ix JOIN embeddings e ON e.vec_id = ix.idx""")
def t10_gather_rows(spark, sf):
    e = FX.embedding_set(spark, sf).select("vec_id", "label")
    n = e.count()
    ix = spark.range(n).select(F.col("id").alias("p"), ((F.col("id") * 7) % (n // 2)).alias("idx"))
    return RG.gather(e, ix, "vec_id", "idx", "p").select("p", "vec_id", "label")


@query("t11_scatter_rows", """
WITH n AS (SELECT count(*) // 2 AS m FROM embeddings),
w AS (SELECT (vec_id * 3) % (SELECT m FROM n) AS row, max_by(label, vec_id) AS value FROM embeddings GROUP BY 1)
SELECT r.row, coalesce(w.value, 0) AS value FROM range((SELECT m FROM n)) r(row) LEFT JOIN w USING (row)""")
def t11_scatter_rows(spark, sf):
    e = FX.embedding_set(spark, sf).select("vec_id", "label")
    m = e.count() // 2
    v = e.select(((F.col("vec_id") * 3) % m).alias("idx"), F.col("vec_id").alias("p"), "label")
    return RG.scatter(v, m, "idx", "p", "label")


GSTD, LSTD, NSEED = 0.15, 0.25, 17


def _g_sql(purpose: str) -> str:
    def h(tag):
        return (f"('0x' || substr(md5(concat_ws(':', '{NSEED}', '{purpose}', CAST(vec_id AS VARCHAR), "
                f"CAST(i - 1 AS VARCHAR), '{tag}')), 1, 8))::BIGINT")
    return (f"(sqrt(-2.0 * ln(({h('g1')} + 1.0) / (4294967296.0 + 1.0))) * "
            f"cos(6.283185307179586 * ({h('g2')} / 4294967296.0)))")


@query("t17_vector_noise", f"""
SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i:
  round(x * (1.0 + {LSTD} * {_g_sql('local')}) + {GSTD} * {_g_sql('global')}, 6) + 0.0) AS noisy
FROM embeddings""")
def t17_vector_noise(spark, sf):
    e = FX.embedding_set(spark, sf)
    return e.select("vec_id", V.round_vec(gaussian_noise(F.col("embedding"), NSEED, [F.col("vec_id")], GSTD, LSTD))
                    .alias("noisy"))


@query("p6_clustered_filter", f"""
SELECT vec_id, label, cluster FROM (SELECT vec_id, label, {PRED_EXPR} AS cluster FROM embeddings) WHERE cluster >= 0""")
def p6_clustered_filter(spark, sf):
    return FX.predictions(spark, sf).where("cluster >= 0").select("vec_id", "label", "cluster")


@query("p7_head_trim", """
WITH n AS (SELECT count(*) AS n FROM embeddings),
padded AS (SELECT vec_id AS sample_idx, vec_id, label FROM embeddings
           UNION ALL SELECT n.n + vec_id, vec_id, label FROM embeddings, n WHERE vec_id < (64 - n.n % 64) % 64)
SELECT sample_idx, vec_id, label FROM padded, n WHERE sample_idx < n.n""")
def p7_head_trim(spark, sf):
    e = FX.embedding_set(spark, sf).select("vec_id", "label")
    n = e.count()
    r = (64 - n % 64) % 64
    padded = e.select(F.col("vec_id").alias("sample_idx"), "vec_id", "label").unionByName(
        e.where(F.col("vec_id") < r).select((F.col("vec_id") + n).alias("sample_idx"), "vec_id", "label"))
    return SH.head_trim(padded, "sample_idx", n)


@query("p8_partition_stack", """
SELECT CASE vec_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS partition, vec_id, label
FROM embeddings""")
def p8_partition_stack(spark, sf):
    e = FX.embedding_set(spark, sf).select("vec_id", "label")
    parts = {name: e.where(F.col("vec_id") % 3 == k) for k, name in enumerate(["train", "val", "test"])}
    return SH.stack_partitions(parts).select("partition", "vec_id", "label")


@query("p9_modality_fusion", f"""
SELECT vec_id, list_transform(embedding, lambda v: round(v, 6) + 0.0) AS embedding, label FROM ({EMB})""")
def p9_modality_fusion(spark, sf):
    e = FX.embedding_set(spark, sf)
    half = 32
    a = e.select("vec_id", F.slice("embedding", 1, half).alias("embedding"), "label")
    b = e.select("vec_id", F.slice("embedding", half + 1, 10 ** 6).alias("embedding"), "label")
    f = SH.fuse_modalities(a, b)
    return f.select("vec_id", V.round_vec("embedding").alias("embedding"), "label")

"""Embedding-quality plans (Q1-Q6) over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import quality as Q
from helixframe.operators.common import r6
from helixframe.plans.registry import query
from helixframe.functions import vectors as V
from helixframe.plans.sqlfix import EMB_U, PAIRS, hash_u32, sqdist_sql
from helixframe.sources import fixtures as FX

_PAIRS_U = f"""WITH U AS ({EMB_U})
SELECT {sqdist_sql('l.x', 'r.x')} AS d_raw, {sqdist_sql('l.u', 'r.u')} AS d_norm,
       list_dot_product(l.u, r.u) AS cos
FROM U l JOIN U r ON l.vec_id < r.vec_id"""


@query("q1_alignment", f"""
WITH p AS ({PAIRS}),
n AS (SELECT list_transform(z1, lambda v: v / greatest(sqrt(list_dot_product(z1, z1)), 1e-12)) AS a,
             list_transform(z2, lambda v: v / greatest(sqrt(list_dot_product(z2, z2)), 1e-12)) AS b FROM p)
SELECT round(avg(pow(sqrt({sqdist_sql('a', 'b')}), 2.0)), 6) + 0.0 AS align FROM n""")
def q1_alignment(spark, sf):
    return Q.alignment(FX.embedding_pairs(spark, sf)).select(r6("align").alias("align"))


@query("q2_uniformity", f"""
SELECT round(ln(avg(exp(-2.0 * d_norm))), 6) + 0.0 AS uniform_t2,
       round(ln(avg(exp(-2.0 * d_raw))), 6) + 0.0 AS uniform_raw_t2,
       round(ln(avg(exp(-1.0 * d_norm))), 6) + 0.0 AS uniform_t1
FROM ({_PAIRS_U})""")
def q2_uniformity(spark, sf):
    u = Q.uniformity(FX.embedding_set(spark, sf))
    return u.select(*[r6(c).alias(c) for c in u.columns])


_MOMENTS_SQL = f"""
WITH p AS ({_PAIRS_U}), n AS (SELECT count(*)::DOUBLE AS n FROM embeddings),
s AS (SELECT 2 * sum(cos) AS s1, 2 * sum(cos * cos) AS s2 FROM p)
SELECT s1 / (n * n) AS e, (s2 - n * n * (s1 / (n * n)) * (s1 / (n * n))) / (n * n - 1) AS v FROM s, n"""


@query("q3_cos_mean", f"SELECT round(e, 6) + 0.0 AS e_costheta FROM ({_MOMENTS_SQL})")
def q3_cos_mean(spark, sf):
    return Q.cosine_moments(FX.embedding_set(spark, sf)).select(r6("e_costheta").alias("e_costheta"))


@query("q4_cos_var", f"SELECT round(v, 9) + 0.0 AS v_costheta FROM ({_MOMENTS_SQL})")
def q4_cos_var(spark, sf):
    m = Q.cosine_moments(FX.embedding_set(spark, sf))
    return m.select((F.round("v_costheta", 9) + F.lit(0.0)).alias("v_costheta"))


@query("q5_widest_angle", f"""
SELECT round(acos(least(min(cos), 0.0)), 6) + 0.0 AS gamma FROM ({_PAIRS_U})""")
def q5_widest_angle(spark, sf):
    return Q.widest_angle(FX.embedding_set(spark, sf)).select(r6("gamma").alias("gamma"))


@query("q6_cos_hist", f"""
WITH p AS ({_PAIRS_U}),
b AS (SELECT least(floor((cos + 1) * 10), 19)::INTEGER AS bin FROM p WHERE cos BETWEEN -1 AND 1),
c AS (SELECT bin, 2 * count(*) AS c FROM b GROUP BY bin)
SELECT r.bin::INTEGER AS bin,
       (coalesce(c.c, 0) + CASE WHEN r.bin = 10 THEN (SELECT count(*) FROM embeddings) ELSE 0 END)::BIGINT AS count
FROM range(20) r(bin) LEFT JOIN c ON c.bin = r.bin""")
def q6_cos_hist(spark, sf):
    return Q.cosine_histogram(FX.embedding_set(spark, sf))


_HIST_SQL = f"""
WITH p AS ({_PAIRS_U}),
b AS (SELECT least(floor((cos + 1) * 10), 19)::INTEGER AS bin FROM p WHERE cos BETWEEN -1 AND 1),
c AS (SELECT bin, 2 * count(*) AS c FROM b GROUP BY bin)
SELECT r.bin::INTEGER AS bin,
       (coalesce(c.c, 0) + CASE WHEN r.bin = 10 THEN (SELECT count(*) FROM embeddings) ELSE 0 END)::BIGINT AS count
FROM range(20) r(bin) LEFT JOIN c ON c.bin = r.bin"""


@query("q7_align_uniform_record", f"""
WITH pr AS ({PAIRS}),
n AS (SELECT list_transform(z1, lambda v: v / greatest(sqrt(list_dot_product(z1, z1)), 1e-12)) AS a,
             list_transform(z2, lambda v: v / greatest(sqrt(list_dot_product(z2, z2)), 1e-12)) AS b FROM pr),
al AS (SELECT avg({sqdist_sql('a', 'b')}) AS align FROM n),
un AS (SELECT ln(avg(exp(-1.0 * d_norm))) AS uniform, acos(least(min(cos), 0.0)) AS gamma FROM ({_PAIRS_U})),
mo AS ({_MOMENTS_SQL}),
h AS (SELECT list(count ORDER BY bin) AS hist FROM ({_HIST_SQL}))
SELECT round(align, 6) + 0.0 AS align, round(uniform, 6) + 0.0 AS uniform, round(e, 6) + 0.0 AS e_costheta,
       round(v, 9) + 0.0 AS v_costheta, hist, round(gamma, 6) + 0.0 AS gamma
FROM al, un, mo, h""")
def q7_align_uniform_record(spark, sf):
    """The whole align/uniform record: first and second views pooled into one set of 2N."""
    from helixframe.operators.common import zip_rows
    pairs = FX.embedding_pairs(spark, sf)
    pooled = pairs.select(F.col("idx") * 2, F.col("z1").alias("embedding")).toDF("vec_id", "embedding") \
        .unionByName(pairs.select((F.col("idx") * 2 + 1).alias("vec_id"), F.col("z2").alias("embedding")))
    d = V.sqeuclidean(V.l2_normalize("z1"), V.l2_normalize("z2"))
    al = pairs.agg(F.avg(d).alias("align"))
    st = Q.pair_statistics(pooled, stats=("uniform_t1", "gamma", "off_hist"))  # one blocked pass: uniformity, min cosine, histogram
    un = st.select(F.col("uniform_t1").alias("uniform"), "gamma",
                   F.transform("off_hist", lambda c, i: (c * 2 + F.when(i == Q.HIST_BINS // 2, F.col("n"))
                                                         .otherwise(F.lit(0))).cast("bigint")).alias("hist"))
    mo = Q.cosine_moments(pooled)
    w = zip_rows(al, un, mo)
    return w.select(r6("align").alias("align"), r6("uniform").alias("uniform"), r6("e_costheta").alias("e_costheta"),
                    (F.round("v_costheta", 9) + F.lit(0.0)).alias("v_costheta"), "hist", r6("gamma").alias("gamma"))


DRAWS, STRATA = 20_000, 64

@query("q2_uniformity_sampled", f"""
WITH U AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, u FROM ({EMB_U})), n AS (SELECT count(*) AS n FROM embeddings),
s AS (SELECT range AS draw, range % {STRATA} AS h, n, (range % {STRATA}) * n // {STRATA} AS lo, (range % {STRATA} + 1) * n // {STRATA} AS hi FROM range({DRAWS}), n),
i AS (SELECT *, lo + (({hash_u32("'0'", "'left'", 'draw')} * (hi - lo)) >> 32) AS i FROM s),
p AS (SELECT *, (i + 1 + (({hash_u32("'0'", "'right'", 'draw')} * (n - 1)) >> 32)) % n AS j FROM i),
f AS (SELECT h, (hi - lo)::DOUBLE / n AS w, exp(-2.0 * {sqdist_sql('a.u', 'b.u')}) AS f FROM p JOIN U a ON a.pos = p.i JOIN U b ON b.pos = p.j),
g AS (SELECT h, max(w) AS w, count(*) AS m, avg(f) AS f, var_samp(f) AS v FROM f GROUP BY h)
SELECT sum(m)::BIGINT AS n_draws, round(ln(sum(w * f)), 6) + 0.0 AS uniform, round(sqrt(sum(w * w * v / m)) / sum(w * f), 6) + 0.0 AS se FROM g""")
def q2_uniformity_sampled(spark, sf):
    u = Q.sampled_uniformity(FX.embedding_set(spark, sf), draws=DRAWS, strata=STRATA)
    return u.select("n_draws", r6("uniform").alias("uniform"), r6("se").alias("se"))

"""Corpus-side plans: view shaping (P1-P5) and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import vectors as V
from helixframe.functions.hashing import acgt_string, gaussian, uniform
from helixframe.operators import encode as EN
from helixframe.operators.common import r6
from helixframe.operators.indexing import dense_index
from helixframe.plans.registry import query
from helixframe.plans.sqlfix import (acgt, ids_sql, mask_sql, pad_sql, tokens_sql, trunc_sql,
                                     uniform as u_sql, vocab_sql)
from helixframe.sources import fixtures as FX
from helixframe.sources.tables import table

DOC_TOK = f"(SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents)"
DOC_VOCAB = f"({vocab_sql(DOC_TOK)})"
DOC_IDS = f"({ids_sql(DOC_TOK, 'doc_id', DOC_VOCAB)})"


def _doc_tokens(spark, sf):
    return FX.documents(spark, sf).select("doc_id", EN.words(F.col("text")).alias("tokens"))


def _doc_lookup(spark, sf):
    return EN.Lookup(EN.vocabulary(_doc_tokens(spark, sf)))


def _doc_ids(spark, sf, head: int | None = None):
    """Whole-text ids, or only the first ``head`` tokens when the caller truncates anyway."""
    t = _doc_tokens(spark, sf)
    tok = F.col("tokens") if head is None else F.slice("tokens", 1, head)
    return t.select("doc_id", _doc_lookup(spark, sf)(tok).alias("ids"))


@query("t1_vocabulary", f"SELECT token, id, count FROM {DOC_VOCAB}")
def t1_vocabulary(spark, sf):
    return EN.vocabulary(_doc_tokens(spark, sf))


@query("t1_token_ids", f"SELECT doc_id, ids FROM {DOC_IDS}")
def t1_token_ids(spark, sf):
    return _doc_ids(spark, sf)


@query("t2_truncate", f"SELECT doc_id, {trunc_sql('ids')} AS input_ids FROM {DOC_IDS}")
def t2_truncate(spark, sf):
    return _doc_ids(spark, sf, head=126).select("doc_id", EN.truncate(F.col("ids")).alias("input_ids"))


@query("t3_pad_mask", f"""
SELECT doc_id, {pad_sql('t')} AS input_ids, {mask_sql('t')} AS attention_mask
FROM (SELECT doc_id, {trunc_sql('ids')} AS t FROM {DOC_IDS})""")
def t3_pad_mask(spark, sf):
    d = _doc_ids(spark, sf, head=126).select("doc_id", EN.truncate(F.col("ids")).alias("t"))
    return d.select("doc_id", EN.pad(F.col("t")).alias("input_ids"),
                    EN.mask_of(F.col("t")).alias("attention_mask"))


@query("p4_column_drop", f"""
SELECT doc_id, {pad_sql(trunc_sql('ids'))} AS input_ids FROM {DOC_IDS}""")
def p4_column_drop(spark, sf):
    """Encode in place, then drop every source column (text, lang, source, n_chars)."""
    d = FX.documents(spark, sf)
    enc = EN.encode(d, "text", _doc_lookup(spark, sf))
    return enc.drop("text", "lang", "source", "n_chars", "attention_mask")


BATCH = 64
MULTIPLE = 8


@query("t4_batch_pad", f"""
WITH l AS (SELECT doc_id, len({trunc_sql('ids')}) AS len, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch
           FROM {DOC_IDS})
SELECT doc_id, batch, len::INTEGER AS len,
       (ceil(least(max(len) OVER (PARTITION BY batch), 128) / {MULTIPLE}) * {MULTIPLE})::INTEGER AS pad_len
FROM l""")
def t4_batch_pad(spark, sf):
    d = _doc_ids(spark, sf, head=126).select("doc_id", F.size(EN.truncate(F.col("ids"))).alias("len"))
    d = dense_index(d, ["doc_id"]).withColumn("batch", (F.col("idx") / BATCH).cast("bigint"))
    return d.select("doc_id", "batch", "len",
                    EN.batch_pad_length(F.col("len"), "batch", 128, MULTIPLE).alias("pad_len"))


@query("p1_null_fill", """
SELECT doc_id, coalesce(CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '' ELSE text END, ' ') AS text
FROM documents""")
def p1_null_fill(spark, sf):
    c = FX.corpus_with_nulls(spark, sf)
    return c.select("doc_id", EN.null_fill(F.col("text")).alias("text"))


_PAIRS_SQL = """SELECT a.conv_id, a.turn, a.text AS sent0, b.text AS sent1
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"""
_H = "('0x' || substr(md5(concat_ws(':', 'neg', CAST(p.conv_id AS VARCHAR))), 1, 8))::BIGINT"
_TRIPLES_SQL = f"""SELECT p.conv_id, p.turn, p.sent0, p.sent1, f.text AS sent2
FROM ({_PAIRS_SQL}) p LEFT JOIN conversations f ON f.turn = 0 AND f.conv_id =
  (p.conv_id + 1 + {_H} % ((SELECT count(*) FROM conversations WHERE turn = 0) - 1))
  % (SELECT count(*) FROM conversations WHERE turn = 0)"""


@query("p2_view_roles", f"SELECT conv_id, turn, sent0, sent1, sent2 FROM ({_TRIPLES_SQL})")
def p2_view_roles(spark, sf):
    from helixframe.operators.shape import resolve_views
    t = FX.conversation_triples(spark, sf)
    return resolve_views(t, ["sent0", "sent1", "sent2"], keys=["conv_id", "turn"])


@query("p2_pair_roles", f"SELECT conv_id, turn, sent0, sent1 FROM ({_PAIRS_SQL})")
def p2_pair_roles(spark, sf):
    """Two columns: a pair."""
    from helixframe.operators.shape import resolve_views
    return resolve_views(FX.conversation_pairs(spark, sf).select("conv_id", "turn", "sent0", "sent1"), keys=["conv_id", "turn"])


@query("p2_self_pair", """SELECT doc_id, coalesce(CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '' ELSE text END, ' ') AS sent0,
coalesce(CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '' ELSE text END, ' ') AS sent1 FROM documents""")
def p2_self_pair(spark, sf):
    """One column: both views are the same text."""
    from helixframe.operators.shape import resolve_views
    return resolve_views(FX.corpus_with_nulls(spark, sf), keys=["doc_id"])


_CONV_TOK = f"(SELECT {tokens_sql('text')} AS tokens FROM conversations)"
_CONV_VOCAB = f"({vocab_sql(_CONV_TOK)})"


def _views_sql():
    trip = f"({_TRIPLES_SQL})"
    stacked = (f"(SELECT conv_id, turn, v.view, {tokens_sql('v.s')} AS tokens FROM {trip} t, "
               f"LATERAL (VALUES (0, t.sent0), (1, t.sent1), (2, t.sent2)) v(view, s))")
    ids = ids_sql(stacked, "conv_id, turn, view", _CONV_VOCAB)
    return (f"SELECT conv_id, turn, list({pad_sql(trunc_sql('ids'))} ORDER BY view) AS input_ids, "
            f"list({mask_sql(trunc_sql('ids'))} ORDER BY view) AS attention_mask FROM ({ids}) "
            f"GROUP BY conv_id, turn")


@query("p3_view_stacking", _views_sql())
def p3_view_stacking(spark, sf):
    from helixframe.operators.shape import encode_views
    conv = table(spark, sf, "conversations").select(EN.words(F.col("text")).alias("tokens"))
    t = FX.conversation_triples(spark, sf)
    return encode_views(t, ["sent0", "sent1", "sent2"], EN.Lookup(EN.vocabulary(conv)),
                        keys=["conv_id", "turn"])


@query("t5_flatten_views", f"""
SELECT conv_id, turn, (view - 1)::INTEGER AS view, input_ids[view] AS input_ids
FROM ({_views_sql()}), LATERAL (SELECT unnest(range(1, len(input_ids) + 1)) AS view)""")
def t5_flatten_views(spark, sf):
    from helixframe.operators.shape import flatten_views
    return flatten_views(p3_view_stacking(spark, sf), ["conv_id", "turn"])


@query("t5_restore_views", f"SELECT conv_id, turn, input_ids FROM ({_views_sql()})")
def t5_restore_views(spark, sf):
    """Flattened views gathered per item again: the stacked views come back."""
    from helixframe.operators.shape import flatten_views, restore_views
    return restore_views(flatten_views(p3_view_stacking(spark, sf), ["conv_id", "turn"]), ["conv_id", "turn"])


@query("u2_mapped_preparation", "SELECT doc_id, len(text)::BIGINT AS n_chars, substr(text, 1, 8) AS head FROM documents")
def u2_mapped_preparation(spark, sf):
    """A user's batched preparation function; the source columns are dropped as it replaces them."""
    from helixframe.operators.hooks import map_batches

    def prepare(pdf):
        return pdf.assign(n_chars=pdf["text"].str.len(), head=pdf["text"].str.slice(0, 8))[["doc_id", "n_chars", "head"]]

    return map_batches(FX.documents(spark, sf).select("doc_id", "text"), prepare, "doc_id bigint, n_chars bigint, head string")


@query("u3_collate_hook", f"""
WITH l AS (SELECT doc_id, len({trunc_sql('ids')}) AS len, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch FROM {DOC_IDS})
SELECT batch, count(*) AS n, max(len)::BIGINT AS longest, sum(len)::BIGINT AS real_tokens FROM l GROUP BY batch""")
def u3_collate_hook(spark, sf):
    """A user's collate function called once for each batch of ``BATCH`` rows."""
    import pandas as pd
    from helixframe.operators.hooks import collate_batches
    d = _doc_ids(spark, sf, head=126).select("doc_id", EN.truncate(F.col("ids")).alias("ids"))

    def collate(pdf):
        size = pdf["ids"].map(len)
        return pd.DataFrame({"n": [len(pdf)], "longest": [int(size.max())], "real_tokens": [int(size.sum())]})

    return collate_batches(d, ["doc_id"], BATCH, collate, "n bigint, longest bigint, real_tokens bigint")


@query("p5_label_alias", "SELECT doc_id, quality::BIGINT AS labels FROM labels")
def p5_label_alias(spark, sf):
    from helixframe.operators.shape import alias_labels
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("label_ids"))
    return alias_labels(lab)


@query("a1_length_profile", f"""
WITH l AS (SELECT v.view, len({trunc_sql('v.ids')}) AS len FROM (
   SELECT 0 AS view, ids FROM {DOC_IDS} UNION ALL
   SELECT 1 AS view, ids FROM {DOC_IDS}) v)
SELECT view::INTEGER AS view, count(*) AS n, min(len)::INTEGER AS min_len, max(len)::INTEGER AS max_len,
       round(avg(len), 6) + 0.0 AS mean_len, round(median(len), 6) + 0.0 AS median_len,
       round(quantile_cont(len, 0.9), 6) + 0.0 AS p90_len
FROM l GROUP BY view""")
def a1_length_profile(spark, sf):
    """S8 + A1: one length per (item, view) - a self pair has two identical views."""
    d = _doc_ids(spark, sf, head=126).select("doc_id", F.size(EN.truncate(F.col("ids"))).alias("len"))
    log = d.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("view"), "len")
    return log.groupBy("view").agg(
        F.count(F.lit(1)).alias("n"), F.min("len").alias("min_len"), F.max("len").alias("max_len"),
        r6(F.avg("len")).alias("mean_len"), r6(F.median("len")).alias("median_len"),
        r6(F.percentile("len", 0.9)).alias("p90_len"))


MLM_SEED, MLM_PROB = 42, 0.15


def _mlm_sql():
    t = f"(SELECT doc_id, {trunc_sql('ids')} AS t FROM {DOC_IDS})"
    x = (f"(SELECT doc_id, unnest(t) AS id, unnest(range(len(t))) AS pos FROM {t})")
    sel = u_sql(str(MLM_SEED), "'sel'", "doc_id", "pos")
    msk = u_sql(str(MLM_SEED), "'mask'", "doc_id", "pos")
    rnd = u_sql(str(MLM_SEED), "'rand'", "doc_id", "pos")
    rid = u_sql(str(MLM_SEED), "'rid'", "doc_id", "pos")
    return f"""
SELECT doc_id, pos::INTEGER AS pos, id AS input_id,
       CASE WHEN s THEN (CASE WHEN {msk} < 0.8 THEN 4 WHEN {rnd} < 0.5 THEN floor({rid} * 4096)::INTEGER ELSE id END)
            ELSE id END AS mlm_id,
       CASE WHEN s THEN id ELSE -100 END AS label
FROM (SELECT *, id NOT IN (0, 2, 3) AND {sel} < {MLM_PROB} AS s FROM {x})"""


@query("t6_mlm_mask", _mlm_sql())
def t6_mlm_mask(spark, sf):
    d = _doc_ids(spark, sf, head=126).select("doc_id", EN.truncate(F.col("ids")).alias("t"))
    x = d.select("doc_id", F.posexplode("t").alias("pos", "input_id"))
    new, lab = EN.mlm_corrupt(F.col("input_id"), MLM_SEED, [F.col("doc_id")], F.col("pos"), MLM_PROB)
    return x.select("doc_id", "pos", "input_id", new.alias("mlm_id"), lab.alias("label"))


SAMPLE_SEED, SAMPLE_FRAC = 42, 0.1


@query("t12_seeded_sample", f"""
SELECT doc_id FROM documents ORDER BY md5(concat_ws(':', '{SAMPLE_SEED}', CAST(doc_id AS VARCHAR))), doc_id
LIMIT (SELECT floor(count(*) * {SAMPLE_FRAC})::BIGINT FROM documents)""")
def t12_seeded_sample(spark, sf):
    from helixframe.operators.shape import seeded_head
    return seeded_head(FX.documents(spark, sf).select("doc_id"), "doc_id", SAMPLE_SEED, SAMPLE_FRAC)


PER_DEVICE, ACCUM, WORLD = 16, 2, 2


_BS = PER_DEVICE * WORLD


@query("t13_batch_plan", f"""
WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents),
b AS (SELECT idx // {_BS} AS batch, count(*) AS n FROM i GROUP BY 1),
p AS (SELECT greatest(count(*) // {ACCUM}, 1) AS per FROM b)
SELECT batch, n, n = {_BS} AS full_batch, CASE WHEN batch // {ACCUM} < per THEN batch // {ACCUM} END AS step FROM b, p""")
def t13_batch_plan(spark, sf):
    from helixframe.operators.shape import batch_plan
    return batch_plan(FX.documents(spark, sf).select("doc_id"), ["doc_id"], _BS, ACCUM)


_PLANS = [("by_epochs", False, 2.5, -1), ("drop_last", True, 3.0, -1), ("by_steps", False, 1.0, 25)]


def _epoch_sql(name, drop_last, epochs, max_steps):
    nb = f"n // {_BS}" if drop_last else f"ceil(n / {_BS}::DOUBLE)::BIGINT"
    steps, ep = (str(max_steps), f"ceil({max_steps} / per::DOUBLE)") if max_steps > 0 else (f"ceil(per * {epochs})", f"ceil({epochs})")
    return (f"SELECT '{name}' AS plan, batches, per AS steps_per_epoch, ({steps})::BIGINT AS max_steps, ({ep})::BIGINT AS epochs FROM "
            f"(SELECT batches, greatest(batches // {ACCUM}, 1) AS per FROM (SELECT ({nb}) AS batches FROM (SELECT count(*) AS n FROM documents)))")


@query("t13_epoch_plan", " UNION ALL ".join(_epoch_sql(*x) for x in _PLANS))
def t13_epoch_plan(spark, sf):
    """Steps per epoch, steps and epochs in all, for a run by epochs, with drop_last, and by steps."""
    from functools import reduce
    from helixframe.operators.shape import epoch_plan
    n = FX.documents(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    rows = [n.select(F.lit(name).alias("plan"), *epoch_plan(F.col("n"), _BS, ACCUM, drop, epochs, steps)) for name, drop, epochs, steps in _PLANS]
    return reduce(lambda a, b: a.unionByName(b), rows)


SHARD_B, SHARD_W = 8, 3


@query("t14_shard_assignment", f"""
SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // {SHARD_B}) % {SHARD_W} AS shard FROM documents""")
def t14_shard_assignment(spark, sf):
    d = dense_index(FX.documents(spark, sf).select("doc_id"), ["doc_id"])
    return d.select("doc_id", F.pmod((F.col("idx") / SHARD_B).cast("bigint"), F.lit(SHARD_W)).alias("shard"))


MUT_RATE = 0.07


@query("t15_mutation", f"""
WITH s AS (SELECT d.doc_id, {acgt('d.doc_id')} AS seq FROM documents d)
SELECT doc_id, seq, list_aggregate(list_transform(range(1, len(seq) + 1), lambda i:
   CASE WHEN {u_sql('7', "'mut'", 'doc_id', 'i')} < {MUT_RATE}
        THEN substr(replace('ACGT', substr(seq, i, 1), ''), 1 + floor({u_sql('7', "'alt'", 'doc_id', 'i')} * 3)::INTEGER, 1)
        ELSE substr(seq, i, 1) END), 'string_agg', '') AS mutated
FROM s""")
def t15_mutation(spark, sf):
    from helixframe.operators.noise import mutate_dna
    s = FX.documents(spark, sf).select("doc_id", acgt_string(F.col("doc_id")).alias("seq"))
    return s.select("doc_id", "seq", mutate_dna(F.col("seq"), 7, [F.col("doc_id")], MUT_RATE).alias("mutated"))


DROP_RATE, TMASK_RATE = 0.1, 0.15


@query("t16_token_drop_mask", f"""
WITH t AS (SELECT doc_id, {trunc_sql('ids')} AS t FROM {DOC_IDS})
SELECT doc_id,
  list_filter(t, lambda x, i: {u_sql('9', "'drop'", 'doc_id', 'i - 1')} >= {DROP_RATE}) AS dropped,
  list_transform(t, lambda x, i: CASE WHEN {u_sql('9', "'tmask'", 'doc_id', 'i - 1')} < {TMASK_RATE} THEN 4 ELSE x END) AS masked
FROM t""")
def t16_token_drop_mask(spark, sf):
    from helixframe.operators.noise import drop_tokens, mask_tokens
    d = _doc_ids(spark, sf, head=126).select("doc_id", EN.truncate(F.col("ids")).alias("t"))
    return d.select("doc_id", drop_tokens(F.col("t"), 9, [F.col("doc_id")], DROP_RATE).alias("dropped"),
                    mask_tokens(F.col("t"), 9, [F.col("doc_id")], TMASK_RATE).alias("masked"))

"""Fixture tables derived from the inputs by Spark (schemas in FIXTURES.md).

Each builder is a lazy DataFrame over the whole input table; nothing is
materialised on the driver.  The SQL twins live in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.hashing import acgt_string, hash_u32, uniform
from helixframe.functions import vectors as V
from helixframe.sources.tables import table

# Fixed fixture parameters.
BATCH = 64          # contrastive batch size (F10)
HARD_NEG_SHIFT = 7  # z3 = z2 of (pos + 7) mod N (F10)
N_LAYERS = 4        # hidden-state layers built for F6
SEQ_LEN = 8         # positions per sequence in F6
CLUSTER_BOOST = 1.5  # added to dimension `label` for F17


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


def corpus_with_nulls(spark, sf) -> DataFrame:
    """F1 with null and empty texts injected (edge rows)."""
    d = documents(spark, sf)
    return d.select(
        "doc_id",
        F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("string"))
         .when(F.col("doc_id") % 13 == 0, F.lit(""))
         .otherwise(F.col("text")).alias("text"))


def labelled_sequences(spark, sf) -> DataFrame:
    """(doc_id, dna_barcode, labels) from documents joined to labels."""
    d = documents(spark, sf).select("doc_id")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return (d.join(lab, "doc_id")
            .select("doc_id", acgt_string(F.col("doc_id")).alias("dna_barcode"),
                    F.col("quality").cast("double").cast("bigint").alias("labels")))


def conversation_pairs(spark, sf) -> DataFrame:
    """consecutive turns (conv_id, turn, sent0, sent1) by an equi-join on turn + 1."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sent1"))
    return (c.withColumnRenamed("text", "sent0")
            .join(nxt, ["conv_id", "turn"]))


def conversation_triples(spark, sf) -> DataFrame:
    """F2 plus a hard negative: turn 0 of another conversation chosen by md5.

    The partner conversation is ``(conv_id + 1 + h mod (m - 1)) mod m`` over the
    dense conversation numbering, h = md5 draw of conv_id: always a different
    conversation when m > 1.
    """
    pairs = conversation_pairs(spark, sf)
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    firsts = c.where("turn = 0").select("conv_id", F.col("text").alias("sent2"))
    m = firsts.count()  # a scalar on the driver; the rows stay distributed
    h = hash_u32(F.lit("neg"), F.col("conv_id"))
    other = (F.pmod(F.col("conv_id") + 1 + F.pmod(h, F.lit(max(m - 1, 1))), F.lit(m))
             if m > 1 else F.col("conv_id"))
    p = pairs.withColumn("_other", other)
    return (p.join(firsts.withColumnRenamed("conv_id", "_other"), "_other", "left")
            .select("conv_id", "turn", "sent0", "sent1", "sent2"))


def embedding_set(spark, sf) -> DataFrame:
    """(vec_id, embedding array<double>, label)."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", V.as_double("embedding").alias("embedding"), "label")


def clustered_embeddings(spark, sf) -> DataFrame:
    """F7 with 1.5 added to dimension `label` (real cluster structure)."""
    e = embedding_set(spark, sf)
    return e.select(
        "vec_id",
        F.transform("embedding", lambda x, i: x + F.when(i == F.col("label"), F.lit(CLUSTER_BOOST))
                    .otherwise(F.lit(0.0))).alias("embedding"),
        "label")


def predicted_cluster(vec_id="vec_id", label="label"):
    v, lab = F.col(vec_id), F.col(label)
    return (F.when(v % 17 == 0, F.lit(-1))
            .when(v % 5 == 0, (lab + 1) % 10)
            .otherwise(lab)).cast("int")


def predictions(spark, sf, base=None) -> DataFrame:
    """F8: (vec_id, label, cluster) with -1 = unclustered."""
    e = base if base is not None else embedding_set(spark, sf)
    return e.withColumn("cluster", predicted_cluster())


def embedding_pairs(spark, sf) -> DataFrame:
    """(idx, z1, z2) = embeddings a (even ids) joined to b.vec_id = a.vec_id + 1."""
    e = embedding_set(spark, sf)
    a = e.where(F.col("vec_id") % 2 == 0).select("vec_id", F.col("embedding").alias("z1"),
                                                  F.col("label").alias("label1"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("z2"),
                 F.col("label").alias("label2"))
    return (a.join(b, "vec_id")
            .select((F.col("vec_id") / 2).cast("bigint").alias("idx"), "z1", "z2",
                    "label1", "label2"))


def contrastive_batches(spark, sf, with_z3: bool = True) -> DataFrame:
    """(batch, pos, z1, z2[, z3]); z3 = z2 at (pos + 7) mod N of the batch."""
    p = embedding_pairs(spark, sf)
    base = p.select((F.col("idx") / BATCH).cast("bigint").alias("batch"),
                    (F.col("idx") % BATCH).cast("int").alias("pos"), "z1", "z2")
    if not with_z3:
        return base
    sizes = base.groupBy("batch").agg(F.count("*").cast("int").alias("n"))
    keyed = base.join(sizes, "batch").withColumn(
        "_src", F.pmod(F.col("pos") + HARD_NEG_SHIFT, F.col("n")))
    z3 = base.select("batch", F.col("pos").alias("_src"), F.col("z2").alias("z3"))
    return keyed.join(z3, ["batch", "_src"]).select("batch", "pos", "z1", "z2", "z3")


def hidden_states(spark, sf) -> DataFrame:
    """(seq_id, layer, pos, mask, h) with layer l holding vector * (l + 1)."""
    e = embedding_set(spark, sf)
    base = e.select((F.col("vec_id") / SEQ_LEN).cast("bigint").alias("seq_id"),
                    (F.col("vec_id") % SEQ_LEN).cast("int").alias("pos"), "embedding")
    layers = base.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(N_LAYERS - 1))))
    return layers.select(
        "seq_id", "layer", "pos",
        (F.col("pos") < 1 + F.col("seq_id") % SEQ_LEN).cast("int").alias("mask"),
        F.transform("embedding", lambda x: x * (F.col("layer") + 1).cast("double")).alias("h"))


def variant_scores(spark, sf) -> DataFrame:
    """(doc_id, score, precomputed_score, label, chrom); score = md5 uniform floored to 0.01 (ties)."""
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    d = documents(spark, sf).select("doc_id", "lang", "n_chars")
    return (lab.join(d, "doc_id")
            .select("doc_id",
                    (F.floor(hash_u32(F.lit("score"), F.col("doc_id")) * 100 / F.lit(4294967296))
                     / F.lit(100.0)).alias("score"),
                    F.col("n_chars").cast("double").alias("precomputed_score"),
                    F.col("quality").cast("int").alias("label"),
                    F.col("lang").alias("chrom")))

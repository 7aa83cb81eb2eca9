"""Training-corpus pipeline: five stages over ``documents``, each one of the operators in ``helixframe.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``docs``:

1. toxicity: rows that score 0.5 or more go.
2. near_duplicates: one document of each group of near copies stays (five-word shingles, similarity 0.8 or more).
3. decontamination: rows that hold text of a benchmark item go.
4. pii: personal data and terms that disclose it are replaced in the text.
5. sentencepiece: the ids of every text, with the check that decoding gives the text back.

Null ids and texts are kept as the operators define; rows repeated under one id with equal text are copies of one
another, so one stays; an empty table passes through.  ``run`` writes each stage to the shared folder before the next reads it.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.llm import op1_pii, op3_sentencepiece, op4_decontaminate, op5_toxicity, op10_minhash
from helixframe.llm.common import read, small_batches, staged


def toxicity(spark, docs, sf_dir):
    return op5_toxicity.kept(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    small_batches(spark)
    return op10_minhash.one_of_each(docs, n=5, percent=80)


def decontamination(spark, docs, sf_dir):
    return op4_decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pii(spark, docs, sf_dir):
    small_batches(spark)
    return op1_pii.sanitised(docs)


def sentencepiece(spark, docs, sf_dir):
    small_batches(spark)
    return op3_sentencepiece.encode(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("sentencepiece", sentencepiece)]

# Compression lengths, term statistics and merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs

"""Registered queries of the training-data operators: production parameters, whole tables."""
from __future__ import annotations

from helixframe.llm import op1_pii, op2_licences, op3_sentencepiece, op4_decontaminate, op5_toxicity, op6_suffixes, op7_embeddings, op8_urls, op9_tokens, op10_minhash, op11_conversations, op12_divergence, op13_warc
from helixframe.llm.common import read


def op2_license_scan(spark, sf_dir):
    return op2_licences.licence_scan(read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return op6_suffixes.remove_repeats(read(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark, sf_dir):
    return op7_embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op8_url_filter(spark, sf_dir):
    return op8_urls.query(spark, read(spark, sf_dir, "pages"))


def op9_token_counts(spark, sf_dir):
    return op9_tokens.token_counts(read(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark, sf_dir):
    return op10_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op1_pii_sanitise(spark, sf_dir):
    return op1_pii.scan(read(spark, sf_dir, "documents"))


def op3_sentencepiece_codec(spark, sf_dir):
    return op3_sentencepiece.round_trip(read(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return op4_decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_toxicity_score(spark, sf_dir):
    return op5_toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_conversation_repair(spark, sf_dir):
    return op11_conversations.repair(read(spark, sf_dir, "conversations"))


def op12_source_divergence(spark, sf_dir):
    return op12_divergence.divergence(read(spark, sf_dir, "documents"))


def op13_warc_segments(spark, sf_dir):
    return op13_warc.query(spark, read(spark, sf_dir, "pages"))


LLM_QUERIES = {f.__name__: f for f in (op1_pii_sanitise, op3_sentencepiece_codec, op4_decontamination, op5_toxicity_score, op2_license_scan, op6_suffix_dedup, op7_embedding_near_dedup, op8_url_filter, op9_token_counts, op10_minhash_near_dedup,
               op11_conversation_repair, op12_source_divergence, op13_warc_segments)}
LLM_ORACLES = {"op4_decontamination": op4_decontaminate.ORACLE, "op2_license_scan": op2_licences.ORACLE, "op7_embedding_near_dedup": op7_embeddings.ORACLE, "op8_url_filter": op8_urls.ORACLE,
               "op10_minhash_near_dedup": op10_minhash.ORACLE, "op11_conversation_repair": op11_conversations.ORACLE, "op12_source_divergence": op12_divergence.ORACLE, "op13_warc_segments": op13_warc.ORACLE}

"""Registered queries of the package: one per operator, over whole tables."""

from __future__ import annotations

from tetrad.llm import (ann, convrepair, exactdedup, jaccard, langid, licenses, mixing, pieces, pii, resample, suffixlm,
                        tokencount, toxicity)
from tetrad.llm.common import documents, labels


def op1_cross_polytope(spark, sf_dir):
    return ann.nearest_of_every(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_license_scan(spark, sf_dir):
    return licenses.scan_documents(documents(spark, sf_dir))


def op3_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op4_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(documents(spark, sf_dir))


def op5_toxicity(spark, sf_dir):
    return toxicity.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_token_counts(spark, sf_dir):
    return tokencount.count_tokens(documents(spark, sf_dir))


def op7_mixing(spark, sf_dir):
    return mixing.mix_report(documents(spark, sf_dir))


def op8_lm_score(spark, sf_dir):
    return suffixlm.score_documents(documents(spark, sf_dir))


def op9_exact_dedup(spark, sf_dir):
    return exactdedup.duplicate_groups(documents(spark, sf_dir))


def op10_ngram_jaccard(spark, sf_dir):
    return jaccard.join_components(documents(spark, sf_dir))


def op11_conversation_repair(spark, sf_dir):
    return convrepair.audit_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_personal_data(spark, sf_dir):
    return pii.scan_documents(documents(spark, sf_dir))


def op13_importance_resampling(spark, sf_dir):
    return resample.resample_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_cross_polytope, op2_license_scan, op3_language_id, op4_sentencepiece, op5_toxicity, op6_token_counts, op7_mixing, op8_lm_score, op9_exact_dedup, op10_ngram_jaccard,
                                 op11_conversation_repair, op12_personal_data, op13_importance_resampling)}

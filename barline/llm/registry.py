"""Queries of the llm operators."""

from __future__ import annotations

import corpus_pipeline

from . import (
    byte_bpe,
    class_model,
    embedding_dedup,
    fingerprints,
    importance_sampling,
    jaccard_join,
    language_id,
    oracle,
    packing,
    periodic_runs,
    repetition,
    secret_scan,
    superkmers,
    whitening,
)


def queries() -> dict:
    found = (
        language_id.op1_language_id,
        superkmers.op2_substring_dedup,
        repetition.op3_quality_rules,
        jaccard_join.op4_jaccard_join,
        byte_bpe.op5_byte_bpe,
        class_model.op6_class_lm,
        embedding_dedup.op7_embedding_near_dedup,
        packing.op8_best_fit_packing,
        importance_sampling.op9_importance_resampling,
        secret_scan.op10_secret_scan,
        whitening.op11_embedding_whitening,
        fingerprints.op12_document_fingerprints,
        periodic_runs.op13_periodic_runs,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.ORACLE)

"""The corpus operators' queries and oracle SQL, by name."""

from __future__ import annotations

from lectern.llm import (
    decontamination,
    importance_sampling,
    language_id,
    lexical_search,
    license_scan,
    line_rules,
    lm_scoring,
    near_duplicates,
    quality_crf,
    secret_scan,
    sentencepiece_codec,
    toxicity,
    url_filter,
)

_QUERIES = (
    sentencepiece_codec.op1_sentencepiece,
    toxicity.op2_toxicity,
    decontamination.op3_benchmark_decontamination,
    secret_scan.op4_secret_scan,
    quality_crf.op5_quality_classifier,
    url_filter.op6_url_filter,
    lm_scoring.op7_lm_scoring,
    language_id.op8_language_id,
    near_duplicates.op9_minhash_near_duplicates,
    line_rules.op10_quality_rules,
    importance_sampling.op11_importance_resampling,
    lexical_search.op12_lexical_search,
    license_scan.op13_license_scan,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return {
        "op6_url_filter": url_filter.OP6_SQL,
        "op9_minhash_near_duplicates": near_duplicates.OP9_SQL,
        "op10_quality_rules": line_rules.OP10_SQL,
        "op11_importance_resampling": importance_sampling.OP11_SQL,
        "op12_lexical_search": lexical_search.OP12_SQL,
    }

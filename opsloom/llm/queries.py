"""The contract queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import conversation_trie, decontaminate, exact_dedup, language_mix, license_scan, near_dedup, quality_knn, secret_markov, sentence_sampling, spelling_variants, substring_dedup, toxicity_cnn, url_rules


def queries() -> dict:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_quality_classifier": quality_knn.op2_quality_classifier,
        "op3_language_id": language_mix.op3_language_id,
        "op4_secret_scans": secret_markov.op4_secret_scans,
        "op5_toxicity": toxicity_cnn.op5_toxicity,
        "op6_url_filters": url_rules.op6_url_filters,
        "op7_sentencepiece": sentence_sampling.op7_sentencepiece,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_conversation_trie": conversation_trie.op11_conversation_trie,
        "op12_license_scans": license_scan.op12_license_scans,
        "op13_spelling_variants": spelling_variants.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": near_dedup.ORACLE_SQL,
        "op6_url_filters": url_rules.ORACLE_SQL,
        "op8_decontamination": decontaminate.ORACLE_SQL,
        "op9_substring_dedup": substring_dedup.ORACLE_SQL,
        "op10_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_conversation_trie": conversation_trie.ORACLE_SQL,
        "op12_license_scans": license_scan.ORACLE_SQL,
        "op13_spelling_variants": spelling_variants.ORACLE_SQL,
    }

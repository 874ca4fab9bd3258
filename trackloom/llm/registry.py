"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from trackloom.llm import decontaminate, filter_audit, language_model, near_dedup, pii, prefix_trie, quality, records, simhash, token_counts, toxicity, unigram, url_rules


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_latent_decontamination": decontaminate.op1_latent_decontamination,
        "op2_pii_semi_crf": pii.op2_pii_semi_crf,
        "op3_binary_records": records.op3_binary_records,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_url_association_rules": url_rules.op6_url_association_rules,
        "op7_cross_entropy_difference": language_model.op7_cross_entropy_difference,
        "op8_unigram_viterbi": unigram.op8_unigram_viterbi,
        "op9_weak_supervision_toxicity": toxicity.op9_weak_supervision_toxicity,
        "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
        "op11_simhash_near_dedup": simhash.op11_simhash_near_dedup,
        "op12_conversation_prefix_trie": prefix_trie.op12_conversation_prefix_trie,
        "op13_filter_interaction_audit": filter_audit.op13_filter_interaction_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_conversation_prefix_trie": prefix_trie.SQL, "op13_filter_interaction_audit": filter_audit.SQL}

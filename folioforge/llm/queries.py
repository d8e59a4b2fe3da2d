"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import automaton_dedup, bfd_packing, context_mixing, knn_quality, language_id, lpf_dedup, lsh_forest, lsm_dedup, norm_topk, pareto_mix


def queries() -> dict:
    return {
        "op1_knn_quality": knn_quality.op1_query,
        "op2_pareto_mix": pareto_mix.op2_query,
        "op3_lsm_exact_dedup": lsm_dedup.op3_query,
        "op4_language_hierarchy": language_id.op4_query,
        "op5_norm_bucket_topk": norm_topk.op5_query,
        "op6_best_fit_packing": bfd_packing.op6_query,
        "op7_lpf_byte_dedup": lpf_dedup.op7_query,
        "op8_context_mixing": context_mixing.op8_query,
        "op9_automaton_word_dedup": automaton_dedup.op9_query,
        "op10_lsh_forest_join": lsh_forest.op10_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_pareto_mix": pareto_mix.OP2_SQL,
        "op3_lsm_exact_dedup": lsm_dedup.OP3_SQL,
        "op5_norm_bucket_topk": norm_topk.OP5_SQL,
        "op7_lpf_byte_dedup": lpf_dedup.OP7_SQL,
        "op9_automaton_word_dedup": automaton_dedup.OP9_SQL,
        "op10_lsh_forest_join": lsh_forest.OP10_SQL,
    }

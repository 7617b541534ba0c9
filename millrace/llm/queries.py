"""The corpus operators' named queries and SQL."""

from __future__ import annotations

from millrace.llm import alignment, byte_bpe, chat_format, decontamination, fingerprints, language_id, mixing, near_dup, periodicity, sharding, token_counts, top_k, url_filter

QUERIES = {
    "op1_pivot_search": top_k.op1_pivot_search,
    "op2_virtual_slots": sharding.op2_virtual_slots,
    "op3_tool_calls": chat_format.op3_tool_calls,
    "op4_improbable_features": fingerprints.op4_improbable_features,
    "op5_prob_min_hash": near_dup.op5_prob_min_hash,
    "op6_length_histogram": token_counts.op6_length_histogram,
    "op7_kneser_ney": language_id.op7_kneser_ney,
    "op8_boosted_trees": url_filter.op8_boosted_trees,
    "op9_raked_mix": mixing.op9_raked_mix,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_wu_manber": decontamination.op12_wu_manber,
    "op13_bit_parallel_lags": periodicity.op13_bit_parallel_lags,
}

ORACLE = {
    "op1_pivot_search": top_k.ORACLE,
    "op2_virtual_slots": sharding.ORACLE,
    "op3_tool_calls": chat_format.ORACLE,
    "op9_raked_mix": mixing.ORACLE,
    "op12_wu_manber": decontamination.ORACLE,
}

"""The subpackage's queries by name, with their SQL equivalents."""

from __future__ import annotations

from prismcat.llm import chat, exact_dedup, hmm_lm, mixing, packing, simhash, substring_dedup, token_files, topk, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_suffix_dedup": substring_dedup.op2_suffix_dedup,
    "op3_chat_rotation": chat.op3_chat_rotation,
    "op4_simhash": simhash.op4_simhash,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_top_k": topk.op6_top_k,
    "op7_hmm_language_model": hmm_lm.op7_hmm_language_model,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_token_files": token_files.op9_token_files,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op3_chat_rotation": chat.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_top_k": topk.OP6_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
}

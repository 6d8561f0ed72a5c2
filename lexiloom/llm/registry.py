"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from lexiloom.llm import chat, decontaminate, embedding_dedup, importance, katz, language_id, minhash, mixing, quality, token_alignment, token_files, url_rules, warc

QUERIES = {
    "op1_probminhash_dedup": minhash.op1_probminhash_dedup,
    "op2_warc_captures": warc.op2_warc_captures,
    "op3_systematic_mix": mixing.op3_systematic_mix,
    "op4_language_id": language_id.op4_language_id,
    "op5_sorted_projections": embedding_dedup.op5_sorted_projections,
    "op6_range_coded_tokens": token_files.op6_range_coded_tokens,
    "op7_chat_format": chat.op7_chat_format,
    "op8_cgk_decontaminate": decontaminate.op8_cgk_decontaminate,
    "op9_katz_backoff": katz.op9_katz_backoff,
    "op10_url_rules": url_rules.op10_url_rules,
    "op11_pu_quality": quality.op11_pu_quality,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLE_SQL = {
    "op2_warc_captures": warc.OP2_SQL,
    "op3_systematic_mix": mixing.OP3_SQL,
    "op5_sorted_projections": embedding_dedup.OP5_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op10_url_rules": url_rules.OP10_SQL,
    "op12_importance_resampling": importance.OP12_SQL,
}

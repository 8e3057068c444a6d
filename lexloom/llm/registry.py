"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, langid, mixing, quality_model, quality_rules, resampling, simhash, suffix_dedup, vector_codes, vector_dedup, warc

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_warc": warc.op5_warc,
    "op6_chat_format": chat.op6_chat_format,
    "op7_language_id": langid.op7_language_id,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_quality_classifier": quality_model.op10_quality_classifier,
    "op11_target_resampling": resampling.op11_target_resampling,
    "op12_vector_dedup": vector_dedup.op12_vector_dedup,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

SQL = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_target_resampling": resampling.OP11_SQL,
    "op12_vector_dedup": vector_dedup.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}

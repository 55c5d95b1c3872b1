"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import embedding_dedup, line_dedup, lm_score, media, packing, quality, sentence_pieces, simhash_dedup, tool_calls, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_media": media.op2_media,
    "op3_tool_calls": tool_calls.op3_tool_calls,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_sentence_pieces": sentence_pieces.op6_sentence_pieces,
    "op7_simhash": simhash_dedup.op7_simhash,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op3_tool_calls": tool_calls.ORACLE_SQL,
    "op9_embedding_dedup": embedding_dedup.ORACLE_SQL,
}

"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from strandloom.llm import alignment, chat, decontamination, jaccard, langid, lines, mixing, negatives, recompression, sharding, suffixes, topk, toxicity

QUERIES = {
    "op1_suffix_dedup": suffixes.op1_suffix_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_chat_format": chat.op3_chat_format,
    "op4_shard": sharding.op4_shard,
    "op5_substring_dedup": recompression.op5_substring_dedup,
    "op6_top_k": topk.op6_top_k,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_language_id": langid.op8_language_id,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_decontaminate": decontamination.op10_decontaminate,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_line_dedup": lines.op13_line_dedup,
}
ORACLES = {"op3_chat_format": chat.ORACLE, "op6_top_k": topk.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op13_line_dedup": lines.ORACLE}

"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import byte_bpe, chat_format, decontaminate, exact_dedup, hard_negatives, jaccard_join, lm_score, pii, prefix_trie, quality, suffix_dedup, token_files, url_filter

QUERIES = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_quality": quality.op2_quality,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_lm_score": lm_score.op4_lm_score,
    "op5_token_files": token_files.op5_token_files,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_pii": pii.op9_pii,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}

ORACLES = {**exact_dedup.ORACLE, **jaccard_join.ORACLE, **url_filter.ORACLE, **chat_format.ORACLE, **decontaminate.ORACLE, **prefix_trie.ORACLE, **hard_negatives.ORACLE, **suffix_dedup.ORACLE}

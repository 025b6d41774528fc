"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from taskprep.llm import decontaminate, katz, langid, lines, merkle, minhash, mixing, passages, quality, runs, simhash, substrings, token_counts

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_minhash_dedup": minhash.op2_minhash_dedup,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_fuzzy_passages": passages.op4_fuzzy_passages,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_katz_scores": katz.op8_katz_scores,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_language_id": langid.op10_language_id,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_word_runs": runs.op12_word_runs,
    "op13_simhash_dedup": simhash.op13_simhash_dedup,
}
ORACLE = {
    "op5_mix_sources": mixing.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_word_runs": runs.ORACLE,
}

"""The registered queries of this subpackage and the SQL that DuckDB compares them with."""

from __future__ import annotations

from nightloom.llm import conversation_repair, decontaminate, fingerprint, importance, language, line_dedup, near_dedup, ngram_lm, quality, sentence_pieces, sharding, token_files, toxicity

QUERIES = {
    "op1_sentence_pieces": sentence_pieces.op1_sentence_pieces,
    "op2_quality": quality.op2_quality,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_fingerprint": fingerprint.op7_fingerprint,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_language": language.op9_language,
    "op10_ngram_lm": ngram_lm.op10_ngram_lm,
    "op11_token_files": token_files.op11_token_files,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_importance": importance.op13_importance,
}
ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_importance": importance.ORACLE,
}

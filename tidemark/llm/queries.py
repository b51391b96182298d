"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, exact_dedup, fingerprints, jaccard, language, mixing, packing, passages, quality, rules, runs, tokens, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_packing": packing.op3_packing,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_chat_format": chat.op7_chat_format,
    "op8_language_id": language.op8_language_id,
    "op9_passages": passages.op9_passages,
    "op10_mixing": mixing.op10_mixing,
    "op11_whitening": whitening.op11_whitening,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_quality_rules": rules.op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": jaccard.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op7_chat_format": chat.SQL,
    "op13_quality_rules": rules.SQL,
}

"""Registered queries of the llm operators, with their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from . import ann, bpe, exact_dedup, lm_scoring, ngram_join, oracles, packing, quality, secrets, sharding, substring_dedup

QUERIES = {
    "op10_secret_scan": secrets.op10_secret_scan,
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_sharding": sharding.op2_sharding,
    "op3_bpe": bpe.op3_bpe,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality": quality.op7_quality,
    "op8_ann": ann.op8_ann,
    "op9_packing": packing.op9_packing,
}

ORACLES = {
    "op1_ngram_join": oracles.NGRAM_JOIN,
    "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op6_exact_dedup": exact_dedup.ORACLE,
}

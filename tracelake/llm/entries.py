"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tracelake.llm import bpe, clusters, decontaminate, exact, lines, lm, neardup, quality, repair, rules, secrets, shards, substring

MODULES = {
    "op1_decontamination": decontaminate,
    "op2_line_dedup": lines,
    "op3_minhash_near_dedup": neardup,
    "op4_secret_scan": secrets,
    "op5_substring_dedup": substring,
    "op6_exact_dedup": exact,
    "op7_lm_scoring": lm,
    "op8_quality_classifier": quality,
    "op9_sharding": shards,
    "op10_bpe": bpe,
    "op11_centroid_clustering": clusters,
    "op12_conversation_repair": repair,
    "op13_quality_rules": rules,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in MODULES.items() if getattr(module, "SQL", None)}

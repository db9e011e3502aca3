"""The ``opN_<name>`` queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, langid, lines, packing, phrases, private, quality, rules, simhash, suffixes

QUERIES = {
    "op1_substring_dedup": phrases.op1_substring_dedup,
    "op2_suffix_array_dedup": suffixes.op2_suffix_array_dedup,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_language_id": langid.op5_language_id,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_pii_pseudonyms": private.op7_pii_pseudonyms,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_quality_classifier": quality.op10_quality_classifier,
    # the part of op3 that SQL can express, under a name of its own
    "quality_base_figures": rules.quality_base_figures,
}
ORACLES = {
    "op1_substring_dedup": phrases.ORACLE,
    "op2_suffix_array_dedup": suffixes.ORACLE,
    "op4_benchmark_decontamination": decontaminate.ORACLE,
    "op9_line_dedup": lines.ORACLE,
    "quality_base_figures": rules.BASE_ORACLE,
}

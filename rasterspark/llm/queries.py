"""The numbered queries, their SQL, and the pipeline, for the repository's entry module."""

from __future__ import annotations

from . import decontaminate, hard_negatives, html_text, license_scan, line_dedup, minhash_dedup, mixing, ngram_join, periodic_runs, quality_model, quality_rules, tool_calls, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_toxicity_chain": toxicity.query,
    "op3_line_dedup": line_dedup.query,
    "op4_benchmark_decontamination": decontaminate.query,
    "op5_tool_call_linking": tool_calls.query,
    "op6_source_mixing": mixing.query,
    "op7_html_extraction": html_text.query,
    "op8_quality_classifier": quality_model.query,
    "op9_quality_rules": quality_rules.query,
    "op10_license_scan": license_scan.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_minhash_dedup": minhash_dedup.query,
}
ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_benchmark_decontamination": decontaminate.ORACLE,
    "op5_tool_call_linking": tool_calls.ORACLE,
    "op6_source_mixing": mixing.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
}

"""Registered queries of the corpus operators and their SQL twins (where SQL can express them)."""

from __future__ import annotations

from barlattice.llm import (
    decontaminate,
    exact_dedup,
    graph_neighbours,
    jaccard_join,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    phrase_mining,
    source_audit,
    substring_dedup,
    suffix_dedup,
    toxicity,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "line_runs": line_dedup.line_runs,
    "op8_language_id": language_id.op8_language_id,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_source_divergence": source_audit.op11_source_divergence,
    "op12_graph_neighbours": graph_neighbours.op12_graph_neighbours,
    "op13_phrase_mining": phrase_mining.op13_phrase_mining,
}

ORACLES = {
    "op4_benchmark_decontamination": decontaminate.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "line_runs": line_dedup.LINE_RUNS_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_source_divergence": source_audit.OP11_SQL,
    "op13_phrase_mining": phrase_mining.OP13_SQL,
}

"""The corpus operators over the given tables, and their checks in SQL where SQL has them."""

from __future__ import annotations

from vesselflow.llm import (
    benchmark_leaks,
    katz,
    license_templates,
    merkle,
    packing,
    quality_rules,
    secret_formats,
    sentence_pieces,
    simhash,
    suffix_dedup,
    toxicity,
    url_rules,
    whitening,
)

QUERIES = {
    "op1_license_scans": license_templates.op1_license_scans,
    "op2_secret_scans": secret_formats.op2_secret_scans,
    "op3_url_filters": url_rules.op3_url_filters,
    "op4_sentence_pieces": sentence_pieces.op4_sentence_pieces,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_katz": katz.op6_katz,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_benchmark_leaks": benchmark_leaks.op8_benchmark_leaks,
    "op9_simhash": simhash.op9_simhash,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_packing": packing.op12_packing,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES = {"op3_url_filters": url_rules.SQL, "op7_quality_rules": quality_rules.SQL, "op13_merkle": merkle.SQL}

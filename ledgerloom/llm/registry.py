"""The text queries, with SQL where SQL can state the result."""

from __future__ import annotations

from ledgerloom.llm import exact_dedup, hard_negatives, html_extraction, merkle_manifest, ngram_join, packing, pii, quality_rules, secret_scan, sentencepiece_codec, suffix_dedup, token_counts, url_filter

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_packing": packing.op6_packing,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_pii": pii.op8_pii,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op11_secret_scan": secret_scan.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_merkle_manifest": merkle_manifest.ORACLE,
}

"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from . import byte_bpe, collocations, filter_audit, fingerprints, html_extract, mixing, quality_classifier, quality_rules, simhash, token_counts, token_files, toxicity, url_filter

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_html_extraction": html_extract.op2_html_extraction,
    "op3_line_quality_rules": quality_rules.op3_line_quality_rules,
    "op4_token_files": token_files.op4_token_files,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_winnowing_fingerprints": fingerprints.op10_winnowing_fingerprints,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op3_line_quality_rules": quality_rules.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op11_phrase_collocations": collocations.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}

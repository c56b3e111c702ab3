"""The queries of this package and their SQL."""

from __future__ import annotations

from . import bpe, decontamination, html_extraction, line_dedup, quality_model, quality_rules, simhash, token_store, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_token_store": token_store.op5_token_store,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_quality_classifier": quality_model.op7_quality_classifier,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc": warc.op10_warc,
}

SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
}

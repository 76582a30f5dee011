"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from casegraph.llm import decontamination, html_text, importance, license_scan, mixing, phrases, quality_rules, secrets, simhash, substring_dedup, suffix_array, token_alignment, toxicity

QUERIES = {
    "op9_html_text": html_text.op9_html_text,
    "op10_decontamination": decontamination.op10_decontamination,
    "op1_importance": importance.op1_importance,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_suffix_array": suffix_array.op4_suffix_array,
    "op5_line_rules": quality_rules.op5_line_rules,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op11_secrets": secrets.op11_secrets,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_phrases": phrases.op13_phrases,
}
ORACLES = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op4_suffix_array": suffix_array.OP4_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op5_line_rules": quality_rules.OP5_SQL,
    "op11_secrets": secrets.OP11_SQL,
    "op13_phrases": phrases.OP13_SQL,
}

"""The queries of the training-data operators, by name, and the SQL that gives the same rows in DuckDB.

Those without opN are the parts of opN_ queries that SQL can express: base spans, rules, targets."""

from __future__ import annotations

from .grades import op6_quality_classifier
from .html import op8_html_extraction
from .leaks import op9_benchmark_decontamination
from .lines import OP3_SQL, op3_line_dedup
from .mixing import TARGETS_SQL, mix_targets, op5_source_mixing
from .pii import BASE_SQL, op2_pii, pii_base
from .quality import OP1_SQL, op1_quality_rules
from .simhash import op10_simhash_near_dedup
from .tokens import op7_token_output
from .urls import RULES_SQL, op4_url_filters, url_rules

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_source_mixing": op5_source_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_output": op7_token_output,
    "op8_html_extraction": op8_html_extraction,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "pii_base": pii_base,
    "url_rules": url_rules,
    "mix_targets": mix_targets,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "pii_base": BASE_SQL,
    "url_rules": RULES_SQL,
    "mix_targets": TARGETS_SQL,
}

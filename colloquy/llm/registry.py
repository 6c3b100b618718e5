"""All queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import centroids, decontaminate, html_text, lm_scoring, packing, quality_classifier, quality_rules, simhash, toxicity, training_order, urls, vector_codes, warc

_MODULES = (centroids, decontaminate, html_text, lm_scoring, packing, quality_classifier, quality_rules, simhash, toxicity, training_order, urls, vector_codes, warc)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}

"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from vellumine.llm import ann, filter_audit, kd_clusters, line_dedup, mixing, packing, quality_classifier, quality_rules, secret_scan, simhash, token_files, toxicity, url_filter

MODULES = (url_filter, ann, simhash, mixing, token_files, quality_rules, quality_classifier, line_dedup, packing, toxicity, kd_clusters, filter_audit, secret_scan)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

"""The subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

from phonolith.llm import ann, decontaminate, divergence, language_id, line_dedup, lm_score, packing, quality, simhash, token_counts, url_filter, warc, whitening

MODULES = (decontaminate, simhash, token_counts, lm_score, quality, url_filter, line_dedup, language_id, warc, packing, whitening, ann, divergence)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}

"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from gridlink.llm import decontamination, language_id, near_dedup, packing, pii, quality_rules, repeats, toxicity, url_filters, warc

_MODULES = (toxicity, near_dedup, packing, language_id, pii, warc, url_filters, decontamination, repeats, quality_rules)
QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

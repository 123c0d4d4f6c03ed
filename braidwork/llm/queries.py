"""The queries of all operators of this subpackage."""

from __future__ import annotations

from . import ann, decontamination, licenses, mixing, near_dedup, pii, sharding, substring_dedup, toxicity, url_filters

MODULES = (decontamination, mixing, ann, licenses, substring_dedup, toxicity, url_filters, sharding, near_dedup, pii)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}

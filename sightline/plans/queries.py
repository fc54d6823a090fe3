"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from . import contract_queries, depth_queries, file_queries, gate_queries, lineage_queries, pair_queries, pixel_queries, record_queries, retrieval_queries

MODULES = (pair_queries, record_queries, pixel_queries, contract_queries, file_queries, gate_queries, retrieval_queries, depth_queries, lineage_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

"""All registered queries and their oracle SQL."""

from __future__ import annotations

from docquarry.plans import answer_queries, eval_queries, ingest_queries, retrieval_queries, source_queries, table_queries

MODULES = (source_queries, ingest_queries, table_queries, retrieval_queries, answer_queries, eval_queries)

QUERIES = {name: fn for module in MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

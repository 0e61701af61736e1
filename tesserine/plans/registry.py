"""All queries of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import analytics_queries, retrieval_queries, summary_queries, trace_queries, understanding_queries

FLAGSHIP = "hybrid_search"
_ALL = {**retrieval_queries.REGISTRY, **analytics_queries.REGISTRY, **trace_queries.REGISTRY, **summary_queries.REGISTRY, **understanding_queries.REGISTRY}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}

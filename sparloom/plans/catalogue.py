"""Every query of the library proper, with its oracle."""

from __future__ import annotations

from . import context_queries, corpus_queries, discovery_queries, domain_queries, event_queries, explore_queries, fact_queries, gate_queries, given_queries, graph_queries, index_queries, relation_queries, repo_queries, review_queries, source_queries, sql_queries, stream_queries

_MODULES = (corpus_queries, graph_queries, event_queries, discovery_queries, source_queries, sql_queries, repo_queries, review_queries, explore_queries, index_queries, stream_queries, fact_queries, relation_queries, given_queries, context_queries, gate_queries, domain_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}

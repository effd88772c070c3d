"""All registered queries of the engine with their DuckDB twins."""

from __future__ import annotations

from cairnlake.plans import cross_queries, entity_queries, lead_queries, marker_queries, network_queries, peer_queries, order_networks, profile_queries, provider_queries, report_queries, rule_queries, run_queries, service_queries, source_queries

_MODULES = (rule_queries, marker_queries, peer_queries, entity_queries, cross_queries, network_queries, order_networks, profile_queries, provider_queries, report_queries, lead_queries, run_queries, service_queries, source_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}

"""Registered queries and their SQL twins."""

from threadlake.plans import capture_queries, detail_queries, export_queries, fact_queries, fidelity_queries, handover_queries, operator_oracles, operator_queries, report_queries, session_queries, stream_queries, summary_queries

_MODULES = (session_queries, fact_queries, report_queries, detail_queries, summary_queries, capture_queries, stream_queries, export_queries, fidelity_queries, handover_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()} | operator_queries.QUERIES
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()} | operator_oracles.ORACLES

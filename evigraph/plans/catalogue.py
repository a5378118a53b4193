"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import detector_queries, findings_queries, graph_queries, history_queries, link_queries, module_queries, path_queries, plugin_queries, resolve_queries, scanner_queries, stream_queries, text_queries, wiring_queries

_MODULES = (detector_queries, findings_queries, graph_queries, history_queries, link_queries, module_queries, path_queries, plugin_queries, resolve_queries, scanner_queries, stream_queries, text_queries, wiring_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

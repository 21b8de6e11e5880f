"""Every operator as a named query over the synthetic tables, and its DuckDB form."""

from __future__ import annotations

from . import geo_queries, gps_queries, graph_queries, render_queries, tag_queries

_MODULES = (geo_queries, tag_queries, graph_queries, render_queries, gps_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

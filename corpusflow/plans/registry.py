"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from . import registry_graph, registry_search

MODULES = (registry_search, registry_graph)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}

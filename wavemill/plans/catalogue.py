"""Every registered query of the engine, with the SQL that checks it."""

from __future__ import annotations

from . import feature_queries, learning_queries, score_queries, stat_queries, table_queries

_MODULES = (score_queries, table_queries, feature_queries, learning_queries, stat_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

"""Queries over the driver's tables, with the SQL that gives the same rows."""

from . import core_queries, geometry_queries, operator_queries, track_queries

_MODULES = (core_queries, geometry_queries, track_queries, operator_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}

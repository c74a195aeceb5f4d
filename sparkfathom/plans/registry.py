"""Registered queries and their oracle SQL, one per operator of the survey."""

from __future__ import annotations

from sparkfathom.plans import evaluation_queries, lifecycle_queries, search_queries, structure_queries, text_queries

_MODULES = (search_queries, text_queries, lifecycle_queries, evaluation_queries, structure_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

"""All queries of the library, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from plexar import queries_events, queries_graph, queries_relational, queries_vector  # noqa: F401 - they register
from plexar.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

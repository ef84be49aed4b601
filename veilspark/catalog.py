"""Registered queries and their SQL."""

from .plans import more, queries, wider

QUERIES = queries.QUERIES | more.QUERIES | wider.QUERIES
ORACLES = queries.ORACLES | more.ORACLES | wider.ORACLES

__all__ = ["ORACLES", "QUERIES"]

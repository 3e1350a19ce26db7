"""Every registered query and its oracle SQL."""

from pliego.queries import domain, incremental, raw, relational, scalar
from pliego.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "domain", "incremental", "raw", "relational", "scalar"]

"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from tidemark.plans import aggregates, calendar, decisions, histories, mapping, mutations, projections, records, requests, scalars, texts  # noqa: F401  they register their queries
from tidemark.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

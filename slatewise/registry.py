"""Registered queries of the library and their SQL."""

from __future__ import annotations

from slatewise.plans import ingest, landing, research
from slatewise.plans.queries import QUERIES, SQL

assert ingest and landing and research  # they register their queries

__all__ = ["QUERIES", "SQL"]

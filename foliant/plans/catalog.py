"""Every registered core query with the SQL that states the same result."""

from __future__ import annotations

from foliant.plans import layout_queries, outline_queries, ranking_queries

_FAMILIES = (layout_queries, ranking_queries, outline_queries)

QUERIES: dict = {name: f for family in _FAMILIES for name, f in family.QUERIES.items()}
ORACLES: dict = {name: text for family in _FAMILIES for name, text in family.ORACLES.items()}

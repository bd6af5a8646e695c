"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from sorrel.plans import budgets, catalog_rules, claims, details, documents, incremental, joins, metrics, ordering, pages, rules, sets, texts, values, windows  # noqa: F401  importing a module registers its queries
from sorrel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

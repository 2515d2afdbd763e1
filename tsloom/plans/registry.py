"""All queries by name, and their DuckDB twins."""

from __future__ import annotations

from tsloom.plans import representations  # noqa: F401  adds its queries
from tsloom.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

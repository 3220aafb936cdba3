"""All queries of the ledger engine, and the SQL that each is held against."""

from __future__ import annotations

from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

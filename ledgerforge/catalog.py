"""All registered finance queries and their DuckDB counterparts."""

from __future__ import annotations

from .plans import figures, judgement, records, stored

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for part in (figures, judgement, records, stored):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL

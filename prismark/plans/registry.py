"""All registered queries of the spectral library with their SQL."""

from __future__ import annotations

from prismark.plans import queries

QUERIES = queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL
FLAGSHIP = queries.screening

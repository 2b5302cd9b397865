"""Registered queries of the reconciliation operators, and the same rows in DuckDB's SQL."""

from reckon.queries import detect, matching, reading, scalars

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (scalars, matching, detect, reading):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE

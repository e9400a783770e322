"""All core queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from lexiquarry import queries_core, queries_engine, queries_skew

QUERIES = {**queries_core.QUERIES, **queries_engine.QUERIES, **queries_skew.QUERIES}
SQL = {**queries_core.SQL, **queries_engine.SQL, **queries_skew.SQL}
flagship = queries_core.flagship

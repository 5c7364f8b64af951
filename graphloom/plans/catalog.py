"""All registered queries of the analytics operators, with their SQL."""

from __future__ import annotations

from . import sql_graph, sql_history, sql_text, sql_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in (sql_history, sql_graph, sql_text, sql_views):
    QUERIES |= _m.q.q
    ORACLE_SQL |= _m.q.s

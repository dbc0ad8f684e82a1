"""All named queries and their SQL."""

from __future__ import annotations

from . import chunks, code, context, events, graph, history, search, sessions, stores, texts

_PARTS = (search, graph, history, sessions, texts, chunks, code, context, events, stores)

QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL: dict[str, str] = {name: text for part in _PARTS for name, text in part.SQL.items()}

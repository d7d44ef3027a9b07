"""Names of the engine's queries and their SQL twins."""

from __future__ import annotations

from . import built_queries, corpus_queries, retrieval_queries, text_queries

MODULES = [text_queries, retrieval_queries, corpus_queries, built_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items() if s}

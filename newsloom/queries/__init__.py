"""Registered queries over the given tables, and the SQL that says the same."""

from __future__ import annotations

from newsloom.queries import article_queries, event_queries, page_queries, profile_queries, source_queries, text_queries

MODULES = [text_queries, article_queries, event_queries, profile_queries, source_queries, page_queries]


def all_queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

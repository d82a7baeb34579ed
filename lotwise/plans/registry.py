"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    from . import form_queries, listing_queries, page_queries, report_queries, request_queries, run_queries, store_queries, text_queries, view_queries  # noqa: F401

    return QUERIES, SQL

"""Registered queries: name to Spark callable, and name to the equal SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    from pourscale.checks import (  # noqa: F401
        q_text, q_items, q_menu, q_sources, q_offers, q_scores, q_match, q_estimates, q_catalog, q_streams,
    )

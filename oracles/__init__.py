"""DuckDB statements that compute the expected result of each query."""

from __future__ import annotations

from importlib import import_module

TOPICS = ["history", "tracking", "market", "reports", "pages", "ingest", "streams"]


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for topic in TOPICS:
        found.update(import_module(f"oracles.{topic}").SQL)
    return found

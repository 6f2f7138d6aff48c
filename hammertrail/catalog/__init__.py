"""Named queries over the driver tables, one module per topic."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

TOPICS = ["history", "tracking", "market", "reports", "pages", "ingest", "streams"]

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for topic in TOPICS:
        found.update(import_module(f"hammertrail.catalog.{topic}").QUERIES)
    return found

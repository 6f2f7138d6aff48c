"""Rows that came too late for a stream: their entities are computed again in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def healed(results: DataFrame, archive: DataFrame, keys: list[str], batch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``results`` of a stream over ``archive``, with the entities of rows that the stream dropped replaced.

    A stream gives one result per row, so a row of ``archive`` without one (by ``id``) came behind the watermark. All
    rows of such entities are computed again with ``batch``; results of other entities stay as they are. The state of
    the stream is not touched: an entity with a late row is taken from the archive from then on.
    """
    done = results.select("id")
    touched = archive.join(done, "id", "left_anti").select(*keys).distinct()
    again = batch(archive.join(touched, keys, "left_semi"))
    return results.join(touched, keys, "left_anti").unionByName(again.select(results.columns))

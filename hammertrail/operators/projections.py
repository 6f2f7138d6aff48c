"""Row projections that leave the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammertrail.functions.text import json_strings
from hammertrail.operators.lookups import keep_first

# --- fixed values -----------------------------------------------------------
TARGET_LABEL = "Vehicule"
# ----------------------------------------------------------------------------


def to_api(snap: DataFrame) -> DataFrame:
    """Snapshots for callers: identifiers never NULL, arrays decoded."""
    out = snap.withColumn("photo_urls", json_strings(F.col("photo_urls")))
    for name in ["reference", "hash_id"]:
        out = out.withColumn(name, F.coalesce(name, F.lit("")))
    if "equipment" in snap.columns:
        out = out.withColumn("equipment", F.from_json("equipment", "array<string>"))
    return out


def identity(entities: DataFrame, reference: Column | None = None, hash_id: Column | None = None) -> DataFrame:
    """Identity columns of entities; an override wins, NULL becomes ''."""

    def chosen(override: Column | None, name: str) -> Column:
        options = [F.col(name), F.lit("")]
        return F.coalesce(*([override] if override is not None else []), *options).alias(name)

    rest = [c for c in entities.columns if c not in ("reference", "hash_id", "first_seen_at", "last_seen_at")]
    return entities.select(*rest, chosen(reference, "reference"), chosen(hash_id, "hash_id"))


def first_photo(photo_urls: Column) -> Column:
    return F.get(json_strings(photo_urls), F.lit(0))


def photo_count(photo_urls: Column) -> Column:
    return F.size(json_strings(photo_urls))


def import_targets(items: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """One target per address with its label, from the first ``limit`` items."""
    rows = items.orderBy(*order).limit(limit) if limit else items
    first = keep_first(rows.filter(F.coalesce("source_url", F.lit("")) != ""), ["source_url"], order)
    parts = [F.nullif(c, F.lit("")) for c in ["brand", "model", "city"]]
    label = F.coalesce(F.nullif(F.concat_ws(" • ", *parts), F.lit("")), "hash_id", F.lit(TARGET_LABEL))
    return first.select(F.col("source_url").alias("url"), label.alias("label"))


def newest_events_first(events: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Events for display: newest passage first, newest event first."""
    return events.orderBy(entity, F.desc("passage_no"), F.desc("scraped_at"), F.desc("id"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a listing; pages count from 1."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)

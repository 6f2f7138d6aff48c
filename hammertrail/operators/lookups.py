"""Joins between entities, snapshots and incoming records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammertrail.functions.text import blank_to_null
from hammertrail.operators.ordering import latest_by

RECENCY = ["scraped_at", "id"]


def with_latest(entities: DataFrame, snap: DataFrame, cols: list[str], key: str = "vehicle_id") -> DataFrame:
    """Entity with the chosen columns of its latest snapshot (prefix last_)."""
    last = latest_by(snap, [key], [F.col(c) for c in RECENCY], [*RECENCY, *[c for c in cols if c not in RECENCY]])
    renamed = last.select(F.col(key).alias("id"), *[F.col(c).alias(f"last_{c}") for c in last.columns if c != key])
    return entities.join(renamed, "id", "left")


def identity_union(entities: DataFrame, snap: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Snapshots of each entity by its id, its reference or its hash.

    Three equi joins whose conditions exclude each other, so no snapshot comes
    twice for an entity and no de-duplication shuffle is needed.
    """
    ids = entities.select(
        F.col("id").alias(entity),
        F.col("_vehicle").alias("_own") if "_vehicle" in entities.columns else F.col("id").alias("_own"),
        blank_to_null(F.col("reference")).alias("_ref"),
        blank_to_null(F.col("hash_id")).alias("_hash"),
    )
    foreign = ~F.col("vehicle_id").eqNullSafe(F.col("_own"))
    by_id = snap.join(ids, snap["vehicle_id"] == ids["_own"])
    by_ref = snap.join(ids, snap["reference"] == ids["_ref"]).filter(foreign)
    by_hash = snap.join(ids, snap["hash_id"] == ids["_hash"]).filter(
        foreign & ~F.coalesce(F.col("reference") == F.col("_ref"), F.lit(False))
    )
    return by_id.unionByName(by_ref).unionByName(by_hash).drop("_own", "_ref", "_hash")


def history_reference(entities: DataFrame, snap: DataFrame, newest_first: bool = False) -> DataFrame:
    """Entity's own reference, else the first one among its snapshots.

    "First" follows scrape time: oldest, or newest when ``newest_first``.
    """
    at = F.struct(*RECENCY)
    pick = F.max_by if newest_first else F.min_by
    found = snap.filter(blank_to_null(F.col("reference")).isNotNull()).groupBy("vehicle_id").agg(
        pick("reference", at).alias("_found")
    )
    return (
        entities.join(found, entities["id"] == found["vehicle_id"], "left")
        .withColumn("reference", F.coalesce(blank_to_null(F.col("reference")), F.col("_found")))
        .drop("vehicle_id", "_found")
    )


def lookup(keys: DataFrame, entities: DataFrame, snap: DataFrame) -> DataFrame:
    """Resolve (key_id, reference, hash_id): both match, else hash, else reference.

    Each priority is an equi join; the lowest entity id wins inside one.
    """
    q = keys.select(
        "key_id",
        blank_to_null(F.trim("reference")).alias("_qref"),
        blank_to_null(F.trim("hash_id")).alias("_qhash"),
    )
    # Only the lowest id of a hash, a reference or a pair can win, so a shared one never multiplies the keys.
    def lowest(*cols: str) -> DataFrame:
        return entities.groupBy(*cols).agg(F.min("id").alias("id"))

    pairs, hashes, references = lowest("hash_id", "reference"), lowest("hash_id"), lowest("reference")
    both = q.join(pairs, (F.col("_qhash") == F.col("hash_id")) & (F.col("_qref") == F.col("reference")))
    by_hash = q.join(hashes, F.col("_qhash") == F.col("hash_id"))
    by_ref = q.join(references, F.col("_qref") == F.col("reference"))
    hits = (
        both.select("key_id", F.lit(1).alias("priority"), "id")
        .unionByName(by_hash.select("key_id", F.lit(2).alias("priority"), "id"))
        .unionByName(by_ref.select("key_id", F.lit(3).alias("priority"), "id"))
    )
    best = hits.groupBy("key_id").agg(F.min(F.struct("priority", "id")).alias("_hit")).select(
        "key_id", "_hit.priority", F.col("_hit.id").alias("vehicle_id")
    )
    stats = snap.groupBy("vehicle_id").agg(
        F.count("*").alias("total_snapshots"),
        F.max_by("id", F.struct(*RECENCY)).alias("last_snapshot_id"),
    )
    return (
        q.select("key_id").join(best, "key_id", "left").join(stats, "vehicle_id", "left")
        .withColumn(
            "total_snapshots",
            F.when(F.col("vehicle_id").isNotNull(), F.coalesce("total_snapshots", F.lit(0))),
        )
    )


def previous_snapshot(batch: DataFrame, snap: DataFrame, cols: list[str]) -> DataFrame:
    """Latest snapshot strictly before each batch record (prefix prev_).

    ``batch`` has vehicle_id and scraped_at, one row per vehicle; the log side
    is reduced by partial aggregation.
    """
    now = batch.select("vehicle_id", F.col("scraped_at").alias("_now"))
    prev = (
        snap.select("vehicle_id", *RECENCY, *[c for c in cols if c not in RECENCY])
        .join(now, "vehicle_id").filter(F.col("scraped_at") < F.col("_now"))
    )
    last = latest_by(prev, ["vehicle_id"], [F.col(c) for c in RECENCY], [*RECENCY, *[c for c in cols if c not in RECENCY]])
    renamed = last.select("vehicle_id", *[F.col(c).alias(f"prev_{c}") for c in last.columns if c != "vehicle_id"])
    return batch.join(renamed, "vehicle_id", "left")


def disappeared(entities: DataFrame, last: DataFrame, batch: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Recently seen, still available entities whose hash left the list.

    ``last`` is ``with_latest`` output. Entities without a hash are left out,
    as the list cannot tell whether they are gone.
    """
    recent = last.filter(
        F.col("hash_id").isNotNull()
        & (F.col("last_seen_at") >= now - F.expr(f"interval {days} days"))
        & (F.col("last_status") == "available")
    )
    listed = batch.select("hash_id").filter(F.col("hash_id").isNotNull())
    return recent.join(listed, "hash_id", "left_anti").select(
        F.col("id").alias("vehicle_id"), "hash_id", "brand", "model",
        F.coalesce("last_city", F.lit("")).alias("last_city"),
        F.coalesce("last_starting_price", F.lit(0)).alias("last_price"),
    )


def in_list(entities: DataFrame, hashes: DataFrame) -> DataFrame:
    """Entities whose hash is among ``hashes``."""
    return entities.join(hashes.select("hash_id"), "hash_id", "left_semi")


def locate_passage(chained: DataFrame, passages: DataFrame, entity: str) -> DataFrame:
    """Passage number and passage total of every snapshot."""
    totals = passages.groupBy(entity).agg(F.count("*").alias("total_passages"))
    # Totals go to the passages first, which are fewer than the snapshots.
    numbered = passages.select(entity, "bucket", "seq", "passage_no").join(totals, entity)
    return chained.join(numbered, [entity, "bucket", "seq"])


def first_known_price(snap: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """First starting price ever recorded; 0 reads as unknown."""
    priced = snap.filter(F.col("starting_price").isNotNull())
    return priced.groupBy(entity).agg(
        F.nullif(F.min_by("starting_price", F.struct(*RECENCY)), F.lit(0)).alias("first_price")
    )


def keep_first(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key: list pages by hash, import targets by url."""
    ranked = items.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def watchlist_view(watch: DataFrame, entities: DataFrame, snap: DataFrame, cols: list[str]) -> DataFrame:
    """Watched entities with their latest snapshot."""
    watched = watch.withColumnRenamed("id", "watch_id").withColumnRenamed("vehicle_id", "id")
    return with_latest(watched.join(entities, "id"), snap, cols)


def watchlist_apply(watch: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply add and delete commands; returns (new watchlist, conflicts).

    ``commands``: action, vehicle_id, notes, alert_on_price,
    alert_on_reappear. Adding a watched entity is a conflict.
    """
    adds = commands.filter(F.col("action") == "add").drop("action")
    gone = commands.filter(F.col("action") == "delete").select("vehicle_id").distinct()
    conflicts = adds.join(watch.select("vehicle_id"), "vehicle_id", "left_semi").select("vehicle_id")
    fresh = keep_first(
        adds.join(watch.select("vehicle_id"), "vehicle_id", "left_anti"), ["vehicle_id"], [F.col("notes")]
    ).select(
        "vehicle_id", F.nullif("notes", F.lit("")).alias("notes"),
        F.coalesce("alert_on_price", F.lit(True)).alias("alert_on_price"),
        F.coalesce("alert_on_reappear", F.lit(True)).alias("alert_on_reappear"),
    )
    kept = watch.select("vehicle_id", "notes", "alert_on_price", "alert_on_reappear").join(
        gone, "vehicle_id", "left_anti"
    )
    return kept.unionByName(fresh), conflicts


def store_totals(entities: DataFrame, snap: DataFrame) -> DataFrame:
    """One row: all entities, all snapshots, and the cities they were seen in."""
    counted = entities.select(F.lit("entity").alias("kind"), F.lit(None).cast("string").alias("city"))
    counted = counted.unionByName(snap.select(F.lit("snapshot").alias("kind"), "city")).groupBy("kind", "city").agg(F.count("*").alias("n"))
    return counted.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "entity", F.col("n"))), F.lit(0)).alias("total_vehicles"),
        F.coalesce(F.sum(F.when(F.col("kind") == "snapshot", F.col("n"))), F.lit(0)).alias("total_snapshots"),
        F.count_if(F.col("city").isNotNull()).alias("cities"),
    )

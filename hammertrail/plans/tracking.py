"""Tracking: what changed between scrapes, and what a list batch brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammertrail.functions import prices as P
from hammertrail.functions.text import blank_to_null, json_strings
from hammertrail.operators import changes as C
from hammertrail.operators import lookups as L
from hammertrail.operators.ordering import with_next, with_previous

DIFF_FIELDS = [
    "starting_price", "sold_price", "starting_price_ht", "market_value", "mileage", "status",
    "lot_number", "city", "sale_date", "observations", "photos",
]


def change_log(snap: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Every snapshot against the one before it, with updates, kind, detail."""
    rows = snap
    if "starting_price_ht" not in rows.columns:
        rows = rows.withColumn("starting_price_ht", F.lit(None).cast("bigint"))
    rows = rows.withColumn("photos", F.size(json_strings(F.col("photo_urls"))))
    rows = rows.select(
        "id", entity, "scraped_at", "brand", "model", F.col("source_url").alias("url"), *DIFF_FIELDS
    )
    paired = with_previous(
        rows, [entity], F.to_date("scraped_at"), [F.col("scraped_at"), F.col("id")], F.struct(*DIFF_FIELDS), "_prev"
    )
    first = F.col("_prev").isNull()
    updates = F.when(
        ~first, C.snapshot_diff({f: F.col(f"_prev.{f}") for f in DIFF_FIELDS}, {f: F.col(f) for f in DIFF_FIELDS})
    )
    return (
        paired.withColumn("updates", updates)
        .withColumn("kind", C.change_kind(F.col("updates"), ~first, first))
        .withColumn("detail", C.change_detail(F.col("updates"), F.col("kind")))
        .withColumn("label", F.concat_ws(" ", "brand", "model"))
        .withColumn(
            "status_changed", F.exists(F.coalesce("updates", F.array()), lambda u: u["field"] == "status")
        )
        .drop("_prev")
    )


def diff_rows(log: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """The change log unpivoted to one row per changed field."""
    return log.select("id", entity, F.explode("updates").alias("u")).select("id", entity, "u.*")


def batch_delta(items: DataFrame, entities: DataFrame, snap: DataFrame, hours: int = 6) -> DataFrame:
    """List items against the store: owner, is_new, suppressed, price move.

    The owner is the entity of the hash, else that of the reference; the
    lowest id wins. Items whose owner was stored within ``hours`` are
    suppressed and bring no price move. The move uses the incoming price as
    it is and needs both prices to be non-zero.
    """
    e = entities.select("id", "hash_id", "reference")
    by_hash = e.filter(F.col("hash_id").isNotNull()).groupBy("hash_id").agg(F.min("id").alias("_hash_owner"))
    by_ref = e.filter(blank_to_null(F.col("reference")).isNotNull()).groupBy("reference").agg(
        F.min("id").alias("_ref_owner")
    )
    owned = (
        items.drop("vehicle_id").join(by_hash, "hash_id", "left").join(by_ref, "reference", "left")
        .withColumn("vehicle_id", F.coalesce("_hash_owner", "_ref_owner"))
        .drop("_hash_owner", "_ref_owner")
    )
    # The stored row is the latest one before the item's scrape.
    now = owned.filter(F.col("vehicle_id").isNotNull()).select("vehicle_id", "hash_id", F.col("scraped_at").alias("_now"))
    stored = (
        snap.select("vehicle_id", "scraped_at", "id", "starting_price").join(now, "vehicle_id")
        .filter(F.col("scraped_at") < F.col("_now"))
        .groupBy("vehicle_id", "hash_id")
        .agg(F.max_by(F.struct("scraped_at", "starting_price"), F.struct("scraped_at", "id")).alias("_last"))
    )
    recent = F.coalesce(
        F.col("_last.scraped_at") >= F.col("scraped_at") - F.expr(f"interval {hours} hours"), F.lit(False)
    )
    diff = P.known(F.col("starting_price")) - P.known(F.col("_last.starting_price"))
    clean = P.scrub_price(
        F.col("starting_price"), F.col("live_price"), F.col("sold_price"), F.lit(None), F.lit(None)
    )
    return (
        owned.join(stored, ["vehicle_id", "hash_id"], "left")
        .withColumn("is_new", F.col("vehicle_id").isNull())
        .withColumn("suppressed", recent)
        .withColumn("price_changed", F.when(~F.col("suppressed"), P.known(diff)))
        .withColumn("stored_price", F.when(~F.col("suppressed"), clean))
        .drop("_last")
    )


def batch_time(items: DataFrame) -> Column:
    """The time of a batch, its latest scrape, as a literal."""
    return F.lit(items.agg(F.max("scraped_at")).first()[0])


def gone_entities(entities: DataFrame, snap: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    last = L.with_latest(entities, snap, ["status", "city", "starting_price"])
    return L.disappeared(entities, last, batch, now)


def watchlist_alerts(watch: DataFrame, found: DataFrame) -> DataFrame:
    """Badges a watcher asked for: price moves and reappearance."""
    price = F.col("type").isin("price_drop", "price_up") & F.col("alert_on_price")
    back = (F.col("type") == "reappeared") & F.col("alert_on_reappear")
    return watch.join(found, "vehicle_id").filter(price | back).select("vehicle_id", "type", "label", "detail")


def _moves(rows: DataFrame, key: str) -> DataFrame:
    """Where the count of ``key`` goes at the next visit that names a stronger key."""
    target = F.when(F.col("canonical") != F.col(key), F.struct("canonical", "visited_at", "visit_id"))
    return with_next(
        rows.filter(F.col(key).isNotNull()), [key], F.to_date("visited_at"),
        ["visited_at", "visit_id"], target, "_next",
    )


def visit_counts(visits: DataFrame) -> DataFrame:
    """Visits per canonical key: entity, else hash, else reference.

    A visit counts under the strongest key it names. When a later visit names
    that key together with a stronger one, the count moves to the stronger
    key: from reference to hash or entity, and from hash to entity.
    """
    rows = visits.select(
        "*",
        F.concat(F.lit("vehicle:"), F.nullif("vehicle_id", F.lit(0).cast("bigint")).cast("string")).alias("k_id"),
        F.concat(F.lit("hash:"), blank_to_null(F.col("hash_id"))).alias("k_hash"),
        F.concat(F.lit("ref:"), blank_to_null(F.col("reference"))).alias("k_ref"),
    ).withColumn("canonical", F.coalesce("k_id", "k_hash", "k_ref")).filter(F.col("canonical").isNotNull())
    spot = rows.select("visited_at", "visit_id", "k_hash", "k_ref", "canonical")

    # Counts under a reference, moved on where a later visit allows it.
    own_ref = F.col("canonical") == F.col("k_ref")
    from_ref = _moves(spot, "k_ref").filter(own_ref).select(
        F.coalesce("_next.canonical", "canonical").alias("at"),
        F.coalesce("_next.visited_at", "visited_at").alias("visited_at"),
        F.coalesce("_next.visit_id", "visit_id").alias("visit_id"),
    )
    counts = from_ref.unionByName(
        spot.filter(~F.coalesce(own_ref, F.lit(False))).select(F.col("canonical").alias("at"), "visited_at", "visit_id")
    )
    # Counts under a hash, one row per arrival, among the visits naming it.
    arrived = counts.filter(F.startswith("at", F.lit("hash:"))).groupBy("at", "visited_at", "visit_id").agg(
        F.count("*").alias("n")
    )
    from_hash = (
        _moves(spot, "k_hash")
        .join(arrived.withColumnRenamed("at", "k_hash"), ["k_hash", "visited_at", "visit_id"])
        .select(F.coalesce("_next.canonical", "k_hash").alias("visit_key"), "n")
    )
    others = counts.filter(~F.startswith("at", F.lit("hash:"))).groupBy(F.col("at").alias("visit_key")).agg(
        F.count("*").alias("n")
    )
    totals = from_hash.unionByName(others).groupBy("visit_key").agg(F.sum("n").alias("visit_count"))

    at = F.struct("visited_at", "visit_id")
    name = F.nullif(F.trim(F.concat_ws(" ", "brand", "model")), F.lit(""))
    last = rows.groupBy(F.col("canonical").alias("visit_key")).agg(
        F.max("visited_at").alias("last_visited_at"),
        F.max_by("source_url", at).alias("last_source_url"),
        F.max_by(F.coalesce(name, F.lit("Vehicule")), at).alias("label"),
    )
    return totals.join(last, "visit_key")

"""Badges, capture planning and capture timelines per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammertrail.functions import prices as P
from hammertrail.functions.text import json_strings
from hammertrail.operators.lookups import RECENCY
from hammertrail.operators.ordering import top_n, with_previous
from hammertrail.operators.passages import passage_key_count

# --- fixed values -----------------------------------------------------------
CAPTURES_KEPT = 20
COOLDOWN_MINUTES = 60
REASON_FIRST = "Première capture"
REASON_NEW = "Nouveau véhicule"
REASON_NEVER = "Jamais capturé"
LABEL_NEW, LABEL_DROP, LABEL_RISE, LABEL_BACK = (
    "Nouveau", "Baisse de prix", "Hausse de prix", "Repasse en vente",
)
# ----------------------------------------------------------------------------

REASON_FIELDS = ["starting_price", "status", "city", "sale_date"]


def newest_first() -> list[Column]:
    return [F.col("scraped_at").desc(), F.col("id").desc()]


def last_two_prices(snap: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Latest and second-latest known starting price."""
    two = top_n(snap.filter(F.col("starting_price").isNotNull()), [entity], newest_first(), 2, "_rn")
    return two.groupBy(entity).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("starting_price"))).alias("last_price"),
        F.max(F.when(F.col("_rn") == 2, F.col("starting_price"))).alias("prev_price"),
    )


def second_to_last_status(snap: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    two = top_n(snap, [entity], newest_first(), 2, "_rn")
    return two.filter(F.col("_rn") == 2).select(entity, F.col("status").alias("prev_status"))


def badges(snap: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """One row per badge: new, seen, price_drop, price_up, reappeared."""
    facts = (
        passage_key_count(snap, entity)
        .join(last_two_prices(snap, entity), entity, "left")
        .join(second_to_last_status(snap, entity), entity, "left")
    )
    n = F.col("passage_count")
    count = n.cast("string")
    diff = F.col("last_price") - F.col("prev_price")
    many = n > 1

    def badge(when: Column, kind: str, label: Column, detail: Column) -> Column:
        return F.when(
            when,
            F.struct(F.lit(kind).alias("type"), label.alias("label"), detail.cast("string").alias("detail")),
        )

    listed = F.array_compact(
        F.array(
            badge(n == 1, "new", F.lit(LABEL_NEW), F.lit(None)),
            badge(many, "seen", F.concat(F.lit("Vu "), count, F.lit(" fois")), F.concat(count, F.lit(" passages"))),
            badge(many & (diff < 0), "price_drop", F.lit(LABEL_DROP), F.concat(diff.cast("string"), F.lit(" €"))),
            badge(many & (diff > 0), "price_up", F.lit(LABEL_RISE), F.concat(F.lit("+"), diff.cast("string"), F.lit(" €"))),
            badge(many & F.col("prev_status").isin("removed", "unsold"), "reappeared", F.lit(LABEL_BACK), F.lit(None)),
        )
    )
    return facts.select(entity, F.explode(listed).alias("b")).select(entity, "b.*")


def list_badges(cards: DataFrame, entities: DataFrame, found: DataFrame) -> DataFrame:
    """Badges of the entities behind the cards of a list, by hash."""
    owners = entities.select(F.col("id").alias("vehicle_id"), "hash_id")
    return cards.select("hash_id").join(owners, "hash_id", "left").join(found, "vehicle_id", "left")


def capture_timeline(snap: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Captures in order with the reason against the capture before."""
    captured = snap.filter("has_screenshot").select(entity, *RECENCY, *REASON_FIELDS, "sold_price")
    paired = with_previous(
        captured, [entity], F.to_date("scraped_at"), [F.col(c) for c in RECENCY], F.struct(*REASON_FIELDS), "_prev"
    )
    reason = P.change_reason(
        {c: F.col(c) for c in REASON_FIELDS}, {c: F.col(f"_prev.{c}") for c in REASON_FIELDS}
    )
    return paired.withColumn(
        "reason", F.when(F.col("_prev").isNull(), F.lit(REASON_FIRST)).otherwise(reason)
    ).drop("_prev")


def retention(snap: DataFrame, entity: str = "vehicle_id", cap: int = CAPTURES_KEPT) -> DataFrame:
    """Captures to prune: all but the oldest and the ``cap - 1`` newest.

    The kept rows are found by map-side limited ranking, so a hot entity does
    not meet in one task.
    """
    captured = snap.filter("has_screenshot").select(entity, *RECENCY)
    newest = top_n(captured, [entity], newest_first(), cap - 1, "_rn").select("id")
    oldest = top_n(captured, [entity], [F.col("scraped_at"), F.col("id")], 1, "_rn").select("id")
    return captured.join(newest.unionByName(oldest), "id", "left_anti")


def latest_and_captured(snap: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Latest snapshot (latest) and latest captured one (captured) as structs."""
    row = F.struct("id", "scraped_at", *REASON_FIELDS, "photo_urls", "has_screenshot", "source_url")
    at = F.struct(*RECENCY)
    shot = F.col("has_screenshot")
    return snap.groupBy(entity).agg(
        F.max_by(row, at).alias("latest"),
        F.max_by(row, F.when(shot, at)).alias("captured"),
    )


def capture_plan(
    entities: DataFrame, snap: DataFrame, hashes: DataFrame, since: Column, now: Column,
    cooldown_minutes: int = COOLDOWN_MINUTES,
) -> DataFrame:
    """Bucket every listed entity: new, modified, missing or skipped."""
    listed = entities.join(hashes.select("hash_id").distinct(), "hash_id", "left_semi")
    rows = listed.join(
        latest_and_captured(snap).withColumnRenamed("vehicle_id", "id"), "id", "left"
    )
    photos = json_strings(F.col("latest.photo_urls"))
    fresh = F.col("latest.has_screenshot") & (
        F.col("latest.scraped_at") > now - F.expr(f"interval {cooldown_minutes} minutes")
    )
    skipped = F.col("latest").isNull() | (F.size(photos) == 0) | fresh
    changed = F.lit(False)
    for c in REASON_FIELDS:
        changed = changed | ~F.col(f"latest.{c}").eqNullSafe(F.col(f"captured.{c}"))
    never = F.col("captured").isNull()
    is_new = never & F.coalesce(F.col("first_seen_at") >= since, F.lit(False))
    bucket = (
        F.when(F.coalesce(skipped, F.lit(True)), F.lit("skipped"))
        .when(is_new, F.lit("new"))
        .when(never, F.lit("missing"))
        .when(changed, F.lit("modified"))
        .otherwise(F.lit("skipped"))
    )
    reason = F.when(F.col("bucket") == "new", F.lit(REASON_NEW)).when(
        F.col("bucket") == "missing", F.lit(REASON_NEVER)
    ).when(
        F.col("bucket") == "modified",
        P.change_reason(
            {c: F.col(f"latest.{c}") for c in REASON_FIELDS}, {c: F.col(f"captured.{c}") for c in REASON_FIELDS}
        ),
    )
    return (
        rows.withColumn("bucket", bucket).withColumn("reason", reason)
        .select(
            F.col("id").alias("vehicle_id"), "hash_id", "bucket", "reason",
            F.col("latest.id").alias("snapshot_id"), F.get(photos, F.lit(0)).alias("thumb_url"),
        )
    )


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("bucket").agg(F.count("*").alias("n"))

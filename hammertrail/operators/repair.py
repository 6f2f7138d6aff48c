"""Repair of polluted records. Every operator returns the change set only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammertrail.functions import prices as P
from hammertrail.functions.text import blank_to_null
from hammertrail.operators.lookups import RECENCY


def placeholder_rules(snap: DataFrame) -> DataFrame:
    """Snapshots at the placeholder price with the rules that disprove it.

    A: a sibling snapshot of the entity has a real price; B: a valuation on
    the same row; C: a bid on the same row.
    """
    floor = P.SIBLING_FLOOR
    proven = snap.filter(F.col("starting_price") >= floor).select("vehicle_id").distinct().withColumn(
        "rule_a", F.lit(True)
    )
    suspects = snap.filter(F.col("starting_price") == P.PLACEHOLDER)
    value = F.greatest("market_value", "new_price")
    return (
        suspects.join(proven, "vehicle_id", "left")
        .withColumn("rule_a", F.coalesce("rule_a", F.lit(False)))
        .withColumn("rule_b", P.at_least(value, P.REPAIR_VALUATION_FLOOR))
        .withColumn("rule_c", P.at_least(F.col("live_price"), P.REPAIR_BID_FLOOR))
    )


def placeholder_repair(snap: DataFrame) -> DataFrame:
    """Ids whose price becomes NULL, tagged with their rules."""
    tags = F.concat_ws(",", *[F.when(F.col(f"rule_{r}"), F.lit(r.upper())) for r in "abc"])
    hit = F.col("rule_a") | F.col("rule_b") | F.col("rule_c")
    return placeholder_rules(snap).filter(hit).select("id", "vehicle_id", tags.alias("rules"))


def rule_overlaps(flags: DataFrame) -> DataFrame:
    """Counts of each rule, their pairwise intersections and their union."""
    a, b, c = F.col("rule_a"), F.col("rule_b"), F.col("rule_c")
    return flags.agg(
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(c).alias("n_c"),
        F.count_if(a & b).alias("n_ab"), F.count_if(a & c).alias("n_ac"), F.count_if(b & c).alias("n_bc"),
        F.count_if(a | b | c).alias("n_any"),
    )


def polluted_entities(snap: DataFrame) -> DataFrame:
    """Entities whose snapshots carry more than one hash."""
    hashed = snap.filter(F.col("hash_id").isNotNull()).select("vehicle_id", "hash_id").distinct()
    return hashed.groupBy("vehicle_id").agg(F.count("*").alias("n_hashes")).filter(F.col("n_hashes") > 1)


def split_polluted(entities: DataFrame, snap: DataFrame) -> DataFrame:
    """Where the snapshots of each foreign hash go.

    The canonical hash is the entity's own one if its snapshots carry it, else
    that of its latest snapshot. Every other hash moves to the entity that
    owns it, else to a new one (``target_id`` NULL, copied from the source).
    """
    per_hash = (
        snap.filter(blank_to_null(F.col("hash_id")).isNotNull())
        .groupBy("vehicle_id", "hash_id")
        .agg(
            F.count("*").alias("n_snapshots"),
            F.max(F.struct(*RECENCY)).alias("_last"),
            F.min("scraped_at").alias("first_seen_at"),
            F.max("scraped_at").alias("last_seen_at"),
        )
    )
    own = entities.select(F.col("id").alias("vehicle_id"), F.col("hash_id").alias("_own"))
    listed = per_hash.join(own, "vehicle_id")
    canonical = listed.groupBy("vehicle_id").agg(
        F.count("*").alias("_n"),
        F.coalesce(
            F.max(F.when(F.col("hash_id") == F.col("_own"), F.col("hash_id"))), F.max_by("hash_id", "_last")
        ).alias("canonical_hash"),
    )
    owners = entities.filter(F.col("hash_id").isNotNull()).select("hash_id", F.col("id").alias("_owner"))
    foreign = listed.join(canonical.filter(F.col("_n") > 1), "vehicle_id").filter(
        F.col("hash_id") != F.col("canonical_hash")
    )
    owned = (
        foreign.select("vehicle_id", "hash_id").join(owners, "hash_id")
        .filter(F.col("_owner") != F.col("vehicle_id"))
        .groupBy("vehicle_id", "hash_id").agg(F.min("_owner").alias("target_id"))
    )
    return (
        foreign.join(owned, ["vehicle_id", "hash_id"], "left")
        .withColumn("creates", F.col("target_id").isNull())
        .select("vehicle_id", "hash_id", "canonical_hash", "n_snapshots", "target_id", "creates",
                "first_seen_at", "last_seen_at")
    )


def new_entities(entities: DataFrame, split: DataFrame) -> DataFrame:
    """Rows for the entities that a split creates: copies without reference."""
    made = split.filter("creates").select(
        F.col("vehicle_id").alias("id"), F.col("hash_id").alias("_hash"),
        F.col("first_seen_at").alias("_first"), F.col("last_seen_at").alias("_last"),
    )
    return (
        entities.join(made, "id").drop("id")
        .withColumn("id", F.xxhash64("_hash"))
        .withColumn("reference", F.lit(None).cast("string"))
        .withColumn("hash_id", F.col("_hash"))
        .withColumn("first_seen_at", F.col("_first"))
        .withColumn("last_seen_at", F.col("_last"))
        .drop("_hash", "_first", "_last")
        .select(*entities.columns)
    )


def move_foreign(snap: DataFrame, split: DataFrame) -> DataFrame:
    """Snapshots with their entity after a split; rows without hash stay."""
    moves = split.select("vehicle_id", "hash_id", F.coalesce("target_id", F.xxhash64("hash_id")).alias("_to"))
    return (
        snap.join(moves, ["vehicle_id", "hash_id"], "left")
        .withColumn("vehicle_id", F.coalesce("_to", "vehicle_id")).drop("_to").select(*snap.columns)
    )


def reparent(
    snap: DataFrame, watch: DataFrame, entities: DataFrame, mapping: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move everything of ``old_id`` to ``new_id`` and drop the old entities.

    A watch flag moves along unless its target is watched already.
    """
    to = mapping.filter(F.col("old_id") != F.col("new_id")).select(
        F.col("old_id").alias("vehicle_id"), F.col("new_id").alias("_to")
    )
    moved = snap.join(to, "vehicle_id", "left").withColumn("vehicle_id", F.coalesce("_to", "vehicle_id")).drop("_to")
    flags = watch.join(to, "vehicle_id", "left").withColumn(
        "_rank", F.struct(F.col("_to").isNotNull(), F.col("vehicle_id"))
    ).withColumn("vehicle_id", F.coalesce("_to", "vehicle_id"))
    kept = flags.groupBy("vehicle_id").agg(
        F.min_by(F.struct(*[c for c in watch.columns if c != "vehicle_id"]), "_rank").alias("_row")
    ).select("vehicle_id", "_row.*").select(*watch.columns)
    left = entities.join(to.select(F.col("vehicle_id").alias("id")), "id", "left_anti")
    return moved.select(*snap.columns), kept, left.select(*entities.columns)

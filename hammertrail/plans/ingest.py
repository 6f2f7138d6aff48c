"""Ingest of a detail batch: resolve, absorb duplicates, fill, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammertrail.functions.text import blank_to_null
from hammertrail.operators import identity as I
from hammertrail.operators import ingest as N
from hammertrail.operators import repair as R
from hammertrail.operators.ordering import numbered
from hammertrail.session import cut_lineage

FACTS = ["version", "color", "fuel", "transmission", "engine_size", "power", "fiscal_power"]


def duplicate_mapping(resolved: DataFrame) -> DataFrame:
    """(old_id, new_id) of entities that a resolution found to be duplicates.

    Several records may name chains or conflicting targets, so the pairs are
    clustered and every duplicate goes to the smallest entity that is nobody's
    duplicate, else to the smallest of its cluster.
    """
    pairs = resolved.filter(F.col("duplicate_id").isNotNull() & (F.col("duplicate_id") != F.col("vehicle_id")))
    pairs = cut_lineage(pairs.select(F.col("duplicate_id").alias("src"), F.col("vehicle_id").alias("dst")).distinct())
    clusters = I.connected_components(pairs)
    old = pairs.select(F.col("src").alias("id")).distinct().withColumn("_old", F.lit(True))
    rank = F.struct(F.coalesce("_old", F.lit(False)).alias("old"), "id")
    target = clusters.join(old, "id", "left").groupBy("cluster").agg(F.min(rank)["id"].alias("new_id"))
    return clusters.join(target, "cluster").select(F.col("id").alias("old_id"), "new_id").filter("old_id <> new_id")


def batch_groups(records: DataFrame) -> DataFrame:
    """(id, group) of records that no stored entity owns; group is the smallest record of the same entity.

    Records of one batch find each other as they would find stored entities:
    by hash, by reference, or by details that are strong. Equal keys are stars
    around their smallest record, so a hot key costs one edge a record.
    """
    def star(key: str) -> DataFrame:
        rows = records.select("id", blank_to_null(F.col(key)).alias("key")).filter("key IS NOT NULL")
        hubs = rows.groupBy("key").agg(F.min("id").alias("src"))
        return rows.join(hubs, "key").filter("id <> src").select("src", F.col("id").alias("dst"))

    as_stored = records.withColumns({f"l_{c}": F.col(c) for c in ["mileage", *I.TEXTS, *I.NUMBERS, *I.MARKS]})
    edges = star("hash_id").unionByName(star("reference")).unionByName(I.duplicate_edges(as_stored))
    clusters = I.connected_components(edges)
    return records.select("id").join(clusters, "id", "left").select("id", F.coalesce("cluster", "id").alias("group"))


def new_ids(groups: DataFrame, entities: DataFrame, snap: DataFrame) -> DataFrame:
    """(id, new_id) of the records in ``groups``: numbers after every one that an entity or a snapshot has had."""
    used = [df.agg(F.max(c)).first()[0] or 0 for df, c in ((entities, "id"), (snap, "vehicle_id"))]
    first = numbered(groups.select("group").distinct(), ["group"], "place")
    first = first.select("group", (F.col("place") + F.lit(max(used) + 1)).alias("new_id"))
    return groups.join(first, "group").select("id", "new_id")


def ingest(
    records: DataFrame, entities: DataFrame, snap: DataFrame, watch: DataFrame
) -> dict[str, DataFrame]:
    """New state of the store after a batch of detail records.

    ``records`` carry the input attributes, id, scraped_at and the snapshot
    columns of ``snap`` without vehicle_id; ``entities`` carry their latest
    snapshot as ``l_`` columns. Records that no entity owns are grouped among
    themselves, and each group becomes one entity with an id of its own.
    Several records of one entity are merged by the streaming job; here the
    latest counts. Returns entities, snapshots to store, watch flags and the
    resolution.
    """
    resolved = cut_lineage(I.resolve(records, entities))
    mapping = duplicate_mapping(resolved)
    log, flags, left = R.reparent(snap, watch, entities, mapping)
    to = mapping.select(F.col("old_id").alias("vehicle_id"), F.col("new_id").alias("_to"))
    nobodys = cut_lineage(records.join(resolved.filter("vehicle_id IS NULL").select("id"), "id", "left_semi"))
    made = new_ids(cut_lineage(batch_groups(nobodys)), entities, snap)
    owner = (
        resolved.select("id", "vehicle_id", "matched_by").join(to, "vehicle_id", "left").join(made, "id", "left")
        .select("id", F.coalesce("_to", "vehicle_id", "new_id").alias("vehicle_id"), "matched_by")
    )
    owned = records.join(owner, "id")
    latest = owned.groupBy("vehicle_id").agg(
        F.max_by(F.struct(*[c for c in owned.columns if c != "vehicle_id"]), F.struct("scraped_at", "id")).alias("r")
    ).select("vehicle_id", "r.*")

    seen_as = [c for c in left.columns if c.startswith("l_") and c.removeprefix("l_") in latest.columns]
    new = latest.select(
        F.col("vehicle_id").alias("id"), F.col("scraped_at").alias("_at"),
        *[F.col(c).alias("n_" + c) for c in ["reference", "hash_id", *FACTS]],
        *[F.col(c.removeprefix("l_")).alias("n_" + c) for c in seen_as],
    ).withColumn("_seen", F.lit(True))
    filled = N.fill_entity_detail(
        {c: F.col(c) for c in ["reference", "hash_id", *FACTS]}, {c: F.col("n_" + c) for c in ["reference", "hash_id", *FACTS]}
    )
    # What the entity was last seen as, and when.
    filled |= {c: F.coalesce("n_" + c, c) for c in seen_as}
    if "last_seen_at" in left.columns:
        filled["last_seen_at"] = F.greatest("last_seen_at", "_at")
    joined = left.join(new, "id", "left")
    updated = joined.select(
        *[F.when(F.col("_seen"), filled[c]).otherwise(F.col(c)).alias(c) if c in filled else F.col(c) for c in left.columns]
    )
    fresh = latest.filter(F.col("matched_by").isNull()).drop("id").withColumnRenamed("vehicle_id", "id")
    known = {c: F.col(c) for c in fresh.columns} | {c: F.col(c.removeprefix("l_")) for c in seen_as}
    known |= {c: F.col("scraped_at") for c in ("first_seen_at", "last_seen_at") if c not in fresh.columns}
    created = fresh.select(*[known.get(c, F.lit(None)).alias(c) for c in left.columns])
    columns = [c for c in log.columns if c in latest.columns]
    stored = N.ingest_batch(latest.select(*columns), log.select(*columns))
    return {"entities": updated.unionByName(created), "snapshots": stored, "watchlist": flags, "resolution": resolved}

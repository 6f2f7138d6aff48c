"""Change, badge, capture, list-batch, watch and repair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hammertrail.catalog.history import entities, run, snapshots
from hammertrail.functions import prices as P
from hammertrail.operators import badges as B
from hammertrail.operators import changes as C
from hammertrail.operators import lookups as L
from hammertrail.operators import passages as S
from hammertrail.operators import projections as X
from hammertrail.operators import repair as R
from hammertrail.operators.evolution import evolution as evolve
from hammertrail.operators.evolution import patch_latest
from hammertrail.plans import history as H
from hammertrail.plans import tracking as T
from hammertrail.session import cut_lineage
from hammertrail.sources.views import load_view


def batch(spark, d):
    return load_view(spark, d, "fx_list_batch")


def micros(name):
    return F.unix_micros(name).alias(name)


def badges(spark, d):
    return B.badges(snapshots(spark, d))


def list_badges(spark, d):
    found = B.badges(snapshots(spark, d))
    return B.list_badges(batch(spark, d), entities(spark, d), found)


def passage_key_count(spark, d):
    return S.passage_key_count(snapshots(spark, d))


def capture_timeline(spark, d):
    return B.capture_timeline(snapshots(spark, d)).select("vehicle_id", F.col("id").alias("snapshot_id"), "reason")


def retention(spark, d):
    return B.retention(snapshots(spark, d)).select("vehicle_id", F.col("id").alias("snapshot_id"))


def _plan(spark, d):
    log = snapshots(spark, d)
    now = T.batch_time(log)
    hashes = entities(spark, d).select("hash_id").filter("hash_id is not null")
    return B.capture_plan(entities(spark, d), log, hashes, now - F.expr("interval 29 days 12 hours"), now)


def capture_plan(spark, d):
    return _plan(spark, d)


def plan_counts(spark, d):
    return B.plan_counts(_plan(spark, d))


def snapshot_diff(spark, d):
    return T.diff_rows(T.change_log(snapshots(spark, d))).withColumnRenamed("id", "snapshot_id")


def change_kind(spark, d):
    return T.change_log(snapshots(spark, d)).select(F.col("id").alias("snapshot_id"), "vehicle_id", "kind", "detail")


def change_search(spark, d):
    log = T.change_log(snapshots(spark, d)).select("id", "kind", "label", "detail", "url")
    return C.search_changes(cut_lineage(log), "price_down", "BRAND3", 2).select(
        F.col("id").alias("snapshot_id"), "kind", "label", "total"
    )


def run_counters(spark, d):
    log = T.change_log(snapshots(spark, d))
    failed = F.when(F.col("observations") == "Véhicule non roulant", F.lit("detail_scrape_failed"))
    return C.run_counters(log.withColumn("error", failed))


def last_errors(spark, d):
    log = snapshots(spark, d)
    failed = F.when(F.col("observations") == "Véhicule non roulant", F.lit("detail_scrape_failed"))
    return C.last_errors(log.withColumn("error", failed)).select("id", "vehicle_id", "error")


def _delta(spark, d):
    return T.batch_delta(batch(spark, d), entities(spark, d), snapshots(spark, d))


def _gone(spark, d):
    items = batch(spark, d)
    return T.gone_entities(entities(spark, d), snapshots(spark, d), items, T.batch_time(items))


def batch_delta(spark, d):
    return _delta(spark, d).select("hash_id", "vehicle_id", "is_new", "suppressed", "price_changed", "stored_price")


def disappeared(spark, d):
    return _gone(spark, d)


def batch_summary(spark, d):
    return C.batch_summary(_delta(spark, d), _gone(spark, d))


def alerts(spark, d):
    return C.alerts(_delta(spark, d), _gone(spark, d))


def list_dedup(spark, d):
    """First card per hash over all pages of a list."""
    cards = snapshots(spark, d).filter("hash_id is not null")
    return L.keep_first(cards, ["hash_id"], [F.col("scraped_at"), F.col("id")]).select("hash_id", "id", "status")


def import_targets(spark, d):
    """One import target per address with its label."""
    return X.import_targets(snapshots(spark, d), [F.col("scraped_at"), F.col("id")])


def api_rows(spark, d):
    """Snapshots as callers see them."""
    rows = X.to_api(snapshots(spark, d))
    return rows.select(
        F.col("id").alias("snapshot_id"), "reference", "hash_id", F.array_join("photo_urls", ",").alias("photos"),
        F.get("photo_urls", F.lit(0)).alias("thumb"),
    )


def lookup(spark, d):
    keys = snapshots(spark, d).select(F.col("id").alias("key_id"), "reference", "hash_id")
    return L.lookup(keys, entities(spark, d), snapshots(spark, d))


def with_previous_price(spark, d):
    rows = L.previous_snapshot(batch(spark, d), snapshots(spark, d), ["starting_price", "status"])
    return rows.select("vehicle_id", "hash_id", "prev_id", "prev_starting_price", "prev_status")


def with_latest(spark, d):
    rows = L.with_latest(entities(spark, d), snapshots(spark, d), ["status", "city", "mileage"])
    return rows.select(F.col("id").alias("vehicle_id"), "brand", "last_id", "last_status", "last_city", "last_mileage")


def store_stats(spark, d):
    """Snapshots and entities per city."""
    rows = snapshots(spark, d).select("city", "vehicle_id")
    per_pair = rows.groupBy("city", "vehicle_id").agg(F.count("*").alias("n"))
    return per_pair.groupBy("city").agg(
        F.sum("n").alias("n_snapshots"), F.count("*").alias("n_vehicles")
    )


def store_totals(spark, d):
    """Entities and snapshots of the store."""
    return L.store_totals(entities(spark, d), snapshots(spark, d))


def watchlist_view(spark, d):
    watch = load_view(spark, d, "fx_watchlist")
    rows = L.watchlist_view(watch, entities(spark, d), snapshots(spark, d), ["status", "starting_price"])
    return rows.select(F.col("id").alias("vehicle_id"), "notes", "alert_on_price", "last_id", "last_status", "last_starting_price")


def watchlist_apply(spark, d):
    """Flags after every entity is added and every sold one deleted."""
    watch = load_view(spark, d, "fx_watchlist")
    adds = entities(spark, d).select(
        F.lit("add").alias("action"), F.col("id").alias("vehicle_id"), F.lit("").alias("notes"),
        F.lit(None).cast("boolean").alias("alert_on_price"), F.lit(False).alias("alert_on_reappear"),
    )
    sold = snapshots(spark, d).filter("status = 'sold' and starting_price is null and hash_id is null").select(
        F.lit("delete").alias("action"), "vehicle_id", F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("boolean").alias("alert_on_price"), F.lit(None).cast("boolean").alias("alert_on_reappear"),
    ).distinct()
    result, _ = L.watchlist_apply(watch, adds.unionByName(sold))
    return result


def watchlist_alerts(spark, d):
    return T.watchlist_alerts(load_view(spark, d, "fx_watchlist"), B.badges(snapshots(spark, d)))


def visits(spark, d):
    return T.visit_counts(load_view(spark, d, "fx_visits")).select(
        "visit_key", "visit_count", "last_source_url", "label", micros("last_visited_at")
    )


def repair_rules(spark, d):
    return R.placeholder_repair(snapshots(spark, d)).withColumnRenamed("id", "snapshot_id")


def rule_overlaps(spark, d):
    return R.rule_overlaps(R.placeholder_rules(snapshots(spark, d)))


def placeholder_scrub(spark, d):
    """Starting prices as they are stored after the write-time rule."""
    price = F.col("starting_price")
    clean = P.scrub_price(price, *[F.col(c) for c in ["live_price", "sold_price", "market_value", "new_price"]])
    return snapshots(spark, d).filter(price.isNotNull()).select(F.col("id").alias("snapshot_id"), clean.alias("stored_price"))


def polluted(spark, d):
    return R.polluted_entities(snapshots(spark, d))


def polluted_split(spark, d):
    split = R.split_polluted(entities(spark, d), snapshots(spark, d))
    return split.select(
        "vehicle_id", "hash_id", "canonical_hash", "n_snapshots", "target_id", "creates",
        micros("first_seen_at"), micros("last_seen_at"),
    )


def polluted_moves(spark, d):
    """Snapshots per entity after the split."""
    log, owners = snapshots(spark, d), entities(spark, d)
    moved = R.move_foreign(log, R.split_polluted(owners, log))
    on_new = F.when(F.col("hash_id").isNotNull(), F.col("vehicle_id") == F.xxhash64("hash_id"))
    return moved.groupBy("hash_id", on_new.alias("on_new")).agg(
        F.count("*").alias("n"), F.sum("id").alias("id_sum")
    )


def _cards(spark, d):
    return batch(spark, d).select("hash_id", F.col("starting_price").alias("card_price"))


def resolved_price(spark, d):
    rows = H.resolved_prices(run(spark, d), _cards(spark, d))
    return rows.select("vehicle_id", "status", "resolved_price")


def patch_history(spark, d):
    h = run(spark, d)
    now = H.resolved_prices(h, _cards(spark, d)).select("vehicle_id", "city", "resolved_price")
    patched = patch_latest(h.kept, now)
    n = patched.groupBy("vehicle_id").agg(F.count_if("patched").alias("n_patched"))
    return evolve(patched).join(n, "vehicle_id").select(
        "vehicle_id", "n_patched", "first_starting_price", "last_effective_price", "evolution_amount"
    )


def current_passage(spark, d):
    """The passage each entity's latest snapshot belongs to, by place and date."""
    h = run(spark, d)
    cols = ["city", "sale_date", "center", "lot_number"]
    now = L.with_latest(entities(spark, d), h.snap, cols).select(
        F.col("id").alias("vehicle_id"), *[f"last_{c}" for c in [*cols, "scraped_at"]]
    )
    rows = h.passages.join(now, "vehicle_id")
    hit = S.is_current(
        {c: F.col(c) for c in ["city", "date", "center", "lot_number"]},
        {c: F.col(f"last_{c}") for c in [*cols, "scraped_at"]},
    )
    return rows.filter(hit).select("vehicle_id", "passage_no")


def headline(spark, d):
    counts = T.visit_counts(load_view(spark, d, "fx_visits"))
    return H.headline(run(spark, d), _cards(spark, d), counts)


QUERIES = {
    f.__name__: f
    for f in [
        badges, list_badges, passage_key_count, capture_timeline, retention, capture_plan, plan_counts,
        snapshot_diff, change_kind, change_search, run_counters, last_errors, batch_delta, disappeared,
        batch_summary, alerts, list_dedup, import_targets, api_rows, lookup, with_previous_price, with_latest,
        store_stats, store_totals, watchlist_view, watchlist_apply, watchlist_alerts, visits, repair_rules,
        rule_overlaps, placeholder_scrub, polluted, polluted_split, polluted_moves, resolved_price,
        patch_history, current_passage, headline,
    ]
}

"""Ingest queries: repeat suppression, merges and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hammertrail.catalog.history import snapshots
from hammertrail.operators import ingest as N
from hammertrail.plans import ingest as I
from hammertrail.sources import readers as R
from hammertrail.sources.views import load_table, load_view, spread


def greedy_list(spark, d):
    """List snapshots that survive the six-hour suppression."""
    return N.list_suppression(snapshots(spark, d)).withColumnRenamed("id", "snapshot_id")


def greedy_detail(spark, d):
    """Insert, enrich or duplicate per detail snapshot, with a six-hour gap."""
    return N.detail_merge(snapshots(spark, d), gap_hours=6).withColumnRenamed("id", "snapshot_id")


def ingest_batch(spark, d):
    """The latest snapshot of every entity merged into the log before it."""
    log = snapshots(spark, d)
    last = log.groupBy("vehicle_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "vehicle_id"]), F.struct("scraped_at", "id")).alias("r"))
    batch = last.select("vehicle_id", "r.*").select(*log.columns)
    older = log.join(batch.select("id"), "id", "left_anti")
    rows = N.ingest_batch(batch, older, gap_hours=12)
    return rows.select("vehicle_id", "action", F.col("id").alias("snapshot_id"), "starting_price", "live_price",
                       "sold_price", "sale_date", "center", "observations", "photo_urls", "status")


def ingest_resolved(spark, d):
    """Entities after a batch of records was resolved and merged."""
    entities = load_view(spark, d, "fx_vehicles")
    records = load_view(spark, d, "fx_records").withColumns(
        {"scraped_at": F.lit("2024-02-01").cast("timestamp"), "status": F.lit("available"), "city": F.lit("C1"),
         "starting_price": F.lit(None).cast("bigint"), "live_price": F.lit(None).cast("bigint"),
         "sold_price": F.lit(None).cast("bigint"), "market_value": F.lit(None).cast("bigint"),
         "new_price": F.lit(None).cast("bigint")}
    )
    log = snapshots(spark, d)
    watch = load_view(spark, d, "fx_watchlist")
    state = I.ingest(records, entities, log, watch)
    return state["entities"].select("id", "reference", "hash_id", "version", "power", "transmission")


def detail_json(spark, d):
    """Events as detail records, split into good ones and rejects by issue."""
    rows = spread(load_table(spark, d, "events")).withColumn("kind", F.col("event_id") % 5)
    body = F.to_json(
        F.struct(
            F.when(F.col("kind") != 1, F.col("event_type")).alias("brand"), F.lit("X").alias("model"),
            F.when(F.col("kind") != 2, F.col("user_id")).alias("mileage"), F.lit("u").alias("sourceUrl"),
            F.col("value").alias("startingPrice"),
        )
    )
    year = F.when(F.col("kind") == 3, F.lit(',"year":"2020"}')).otherwise(F.lit(',"year":2020}'))
    text = F.concat(F.expr("substring(_b, 1, length(_b) - 1)"), year)
    lines = rows.withColumn("_b", body).select(F.when(F.col("kind") == 4, F.lit("{oops")).otherwise(text).alias("value"))
    good, rejects = R.validate_details(lines)
    ok = good.select(F.concat(F.lit("ok "), "status").alias("issue"))
    return ok.unionByName(rejects.select(F.array_join("issues", ",").alias("issue"))).groupBy("issue").agg(F.count("*").alias("n"))


def list_json(spark, d):
    """Events as list items; bad ones are skipped one by one."""
    item = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 5 != 1, F.col("event_type")).alias("hashId"),
            F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(F.lit("x12")).alias("mileage"),
            F.col("value").alias("startingPrice"),
        )
    )
    lines = spread(load_table(spark, d, "events")).select(F.concat(F.lit('{"vehicles":['), item, F.lit("]}")).alias("value"))
    items = R.validate_items(lines)
    return items.groupBy("valid").agg(F.count("*").alias("n"), F.sum(F.when(F.col("valid"), F.col("mileage"))).cast("bigint").alias("mileage"))


QUERIES = {f.__name__: f for f in [greedy_list, greedy_detail, ingest_batch, ingest_resolved, detail_json, list_json]}

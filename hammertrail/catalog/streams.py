"""Streaming queries: the tables are drained as streams to completion."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from hammertrail.catalog.history import entities, snapshots
from hammertrail.operators import ingest as N
from hammertrail.operators import passages
from hammertrail.operators.ordering import with_previous
from hammertrail.plans import tracking as T
from hammertrail.session import shared_dir
from hammertrail.sources.views import load_table, load_view, view_sql
from hammertrail.streaming import jobs as J
from hammertrail.streaming import processors as C
from hammertrail.streaming.late import healed


def _stream(spark, d, view, per_trigger=100):
    """A view over the events table, read as a stream of ``per_trigger`` files at a time in no order of events."""
    events = J.read_stream(load_table(spark, d, "events"), f"{d}/events.parquet", per_trigger)
    return spark.sql(view_sql(view, "spark").replace("FROM events", "FROM {events}"), events=events)


def _folded(spark, d, name, rows_of, fold, per_trigger=100, late=C.LATE):
    """Results of one fold over the snapshots as a stream that ends."""
    where = J.folder(spark, name)
    rows = rows_of(_stream(spark, d, "fx_snapshots", per_trigger))
    return J.drain(fold(J.with_end(rows, where), late=late), name, where=where, ends=rows)


def _moves(log):
    """Batch form of the list stream: every row, whether it is stored, and its price move."""
    kept = N.list_suppression(log).withColumn("stored", F.lit(True))
    priced = log.select("id", "vehicle_id", "scraped_at", "starting_price").join(kept, ["id", "vehicle_id"], "left")
    stored = with_previous(
        priced.filter("stored"), ["vehicle_id"], F.to_date("scraped_at"), [F.col("scraped_at"), F.col("id")],
        F.struct("starting_price"), "before",
    )
    moved = F.col("starting_price") - F.col("before.starting_price")
    moved = F.when((F.col("starting_price") != 0) & (F.col("before.starting_price") != 0) & (moved != 0), moved)
    rest = priced.filter("stored IS NULL").select("vehicle_id", "id", F.unix_micros("scraped_at").alias("us"), F.lit(False).alias("stored"), F.lit(None).cast("bigint").alias("price_changed"))
    return stored.select("vehicle_id", "id", F.unix_micros("scraped_at").alias("us"), "stored", moved.alias("price_changed")).unionByName(rest)


def list_moves(spark, d, per_trigger=100, late=C.LATE):
    found = _folded(spark, d, "list", C.list_rows, C.list_stream, per_trigger, late)
    return healed(found, snapshots(spark, d), ["vehicle_id"], _moves).filter("stored")


def detail_actions(spark, d, per_trigger=100, late=C.LATE):
    found = _folded(spark, d, "detail", C.detail_rows, partial(C.ingest_stream, gap_hours=6), per_trigger, late)
    return healed(found, snapshots(spark, d), ["vehicle_id"], partial(N.detail_merge, gap_hours=6))


def passage_numbers(spark, d, per_trigger=100, late=C.LATE):
    found = _folded(spark, d, "passages", C.passage_rows, C.passage_stream, per_trigger, late)
    return healed(found, snapshots(spark, d), ["vehicle_id"], passages.sessionise).select("vehicle_id", "bucket", "id", "seq")


def stream_list(spark, d):
    return list_moves(spark, d).select(F.col("id").alias("snapshot_id"), "vehicle_id", "price_changed")


def stream_detail(spark, d):
    return detail_actions(spark, d).withColumnRenamed("id", "snapshot_id")


def stream_passages(spark, d):
    return passage_numbers(spark, d).withColumnRenamed("id", "snapshot_id")


def stream_visits(spark, d):
    out = J.drain(J.visit_stream(_stream(spark, d, "fx_visits", 100)), "visits", "update")
    return J.newest(out, ["visit_key"]).select("visit_key", "visit_count", F.unix_micros("last_visited_at").alias("last_visited_at"))


def stream_activity(spark, d):
    out = J.drain_activity(_stream(spark, d, "fx_snapshots"), "activity")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def stream_sliding(spark, d):
    out = J.drain_activity(_stream(spark, d, "fx_snapshots"), "sliding", "12 hours", "6 hours")
    return out.select(F.unix_micros("start").alias("start"), "status", "n")


def stream_alerts(spark, d):
    return J.watchlist_alerts(list_moves(spark, d), load_view(spark, d, "fx_watchlist")).select("vehicle_id", F.col("id").alias("snapshot_id"), "price_changed", "type")


def stream_vanished(spark, d):
    """Entities missing from the last list batch, found from its stream."""
    where = f"{shared_dir(spark)}/vanished-{uuid.uuid4().hex[:8]}"
    owners, log = entities(spark, d), snapshots(spark, d)
    listed = load_view(spark, d, "fx_list_batch")
    listed.select("hash_id", "scraped_at").write.parquet(f"{where}/in")
    # The check needs the whole list, so its files are one micro-batch.
    items = J.read_stream(listed.select("hash_id", "scraped_at"), f"{where}/in", None)

    def sink(batch, number):
        gone = T.gone_entities(owners, log, batch, T.batch_time(batch))
        gone.write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    J.vanished_stream(items, sink, where)
    return spark.read.parquet(f"{where}/out").drop("batch")


QUERIES = {
    f.__name__: f
    for f in [
        stream_list, stream_detail, stream_passages, stream_visits, stream_activity, stream_sliding,
        stream_alerts, stream_vanished,
    ]
}

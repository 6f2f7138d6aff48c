"""History queries over the snapshot log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammertrail.operators import evolution as E
from hammertrail.operators import lookups as L
from hammertrail.operators import passages as S
from hammertrail.plans import history as H
from hammertrail.sources.views import load_view


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_view(spark, sf_dir, "fx_snapshots")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_view(spark, sf_dir, "fx_entities")


def run(spark: SparkSession, sf_dir: str) -> H.History:
    return H.History(snapshots(spark, sf_dir))


def passages(spark, d):
    return run(spark, d).passages.select(
        "vehicle_id", "passage_no", "date", "snapshot_id", "status", "city", "center", "sale_time",
        "lot_number", "observations", "technical_check_url", "starting_price", "live_price",
        "sold_price", "mileage", "n_snapshots",
    )


def canonical(spark, d):
    return run(spark, d).passages.select("vehicle_id", "bucket", "seq", "snapshot_id", "status", "sold_price")


def consensus_date(spark, d):
    return run(spark, d).passages.select("vehicle_id", "bucket", "seq", "date", "passage_no")


def start_trajectory(spark, d):
    return run(spark, d).starts.select("vehicle_id", "bucket", "seq", "pos", F.col("starting_price").alias("price"))


def live_trajectory(spark, d):
    return run(spark, d).lives.select("vehicle_id", "bucket", "seq", "pos", F.col("live_price").alias("price"))


def event_compression(spark, d):
    return run(spark, d).events.select(
        "vehicle_id", "passage_no", F.col("id").alias("snapshot_id"), "status", "starting_price",
        "live_price", "sold_price", "mileage", "event_mode", "event_reason",
    )


def latest_live(spark, d):
    return run(spark, d).passages.filter("live_price is not null").select("vehicle_id", "passage_no", "live_price")


def auction_price(spark, d):
    return run(spark, d).passages.select("vehicle_id", "passage_no", "presale_price", "mode_price", "starting_price")


def first_known(spark, d):
    h = run(spark, d)
    return h.passages.join(L.first_known_price(h.snap), "vehicle_id", "left").select(
        "vehicle_id", "passage_no", "sale_time", "center", "lot_number", "observations",
        "technical_check_url", "mileage", "first_price",
    )


def final_sale_cut(spark, d):
    return run(spark, d).passages.select("vehicle_id", "passage_no", "date", "status", "cutoff", "truncated")


def evolution(spark, d):
    return run(spark, d).evolution


def price_history(spark, d):
    return run(spark, d).price_history


def series_summary(spark, d):
    return E.series_summary(run(spark, d).price_history)


def navigation(spark, d):
    return run(spark, d).passages.select(
        "vehicle_id", "passage_no", "snapshot_id", "is_stable", "open_mode", "open_reason"
    )


def mileage_history(spark, d):
    return run(spark, d).kept.select("vehicle_id", "passage_no", "date", "mileage")


def evidence(spark, d):
    return S.snapshot_evidence(snapshots(spark, d), "vehicle_id")


def history_document(spark, d):
    return H.history_summary(entities(spark, d), snapshots(spark, d))


def identity_union(spark, d):
    named = L.history_reference(entities(spark, d), snapshots(spark, d))
    return L.identity_union(named, snapshots(spark, d)).groupBy("entity_id").agg(
        F.count("*").alias("n_snapshots"),
        F.count_if(F.col("vehicle_id") != F.col("entity_id")).alias("n_foreign"),
        F.sum("id").alias("id_sum"),
    )


def cross_auction(spark, d):
    return H.cross_auction(entities(spark, d), snapshots(spark, d))


def snapshot_view(spark, d):
    return H.snapshot_view(snapshots(spark, d))


QUERIES = {
    f.__name__: f
    for f in [
        passages, canonical, consensus_date, start_trajectory, live_trajectory, event_compression,
        latest_live, auction_price, first_known, final_sale_cut, evolution, price_history,
        series_summary, navigation, mileage_history, evidence, history_document, identity_union,
        cross_auction, snapshot_view,
    ]
}

"""Similarity, price intelligence, auction and identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hammertrail.catalog.history import run
from hammertrail.functions import prices as P
from hammertrail.functions import text as X
from hammertrail.operators import badges as B
from hammertrail.operators import identity as I
from hammertrail.operators import similar as S
from hammertrail.operators import summaries as M
from hammertrail.sources.views import load_view


def vehicles(spark, d):
    return load_view(spark, d, "fx_vehicles")


def lots(spark, d):
    return load_view(spark, d, "fx_lots")


def latest_items(spark, d):
    """Entities that have a snapshot, under the attributes of that snapshot."""
    cols = ["color", "fuel", "transmission", "engine_size", "power", "mileage"]
    keep = [c for c in vehicles(spark, d).columns if not c.startswith("l_") and c not in cols]
    return vehicles(spark, d).filter("l_mileage is not null").select(
        *keep, *[F.col(f"l_{c}").alias(c) for c in cols]
    )


def similarity(spark, d):
    return S.match_summary(latest_items(spark, d))


def offers_elsewhere(spark, d):
    offers = S.offers_elsewhere(latest_items(spark, d))
    return offers.select(
        "id", "rank", "offer_id", "score", "level", "price_diff", "km_diff", "tone",
        F.array_join("deltas", " · ").alias("deltas"),
    )


def offers_summary(spark, d):
    return S.offers_summary(S.offers_elsewhere(latest_items(spark, d)))


def _same_model(spark, d):
    items = vehicles(spark, d).select("id", "brand", "model", "year", F.col("l_mileage").alias("mileage"), "starting_price")
    return S.same_model(items)


def same_model(spark, d):
    ids = F.transform("others", lambda x: x["id"].cast("string"))
    return _same_model(spark, d).select("id", F.array_join(ids, ",").alias("others"))


def same_model_avg(spark, d):
    rows = S.same_model_averages(_same_model(spark, d))
    return rows.select(
        "id", "n_others", *[P.half_up(F.col(c)).alias(c) for c in ["avg_year", "avg_mileage", "avg_starting_price"]],
        "mileage_verdict", "starting_price_verdict",
    )


def _sold(spark, d):
    rows = lots(spark, d)
    queries = rows.select("brand", "model", "year", "mileage", F.col("hash_id").alias("exclude_hash"))
    return S.similar_sold(queries, rows)


def similar_sold(spark, d):
    return _sold(spark, d).drop("results")


def similar_sold_top(spark, d):
    """The ranked comparables behind the statistics."""
    rows = _sold(spark, d).select("exclude_hash", F.posexplode("results").alias("pos", "r"))
    return rows.select("exclude_hash", (F.col("pos") + 1).alias("rank"), F.col("r.id").alias("lot_id"),
                       F.col("r.sold_price").alias("sold_price"), F.col("r.fits").alias("comparable"))


def verdict(spark, d):
    rows = lots(spark, d).withColumn("exclude_hash", F.col("hash_id"))
    stats = _sold(spark, d).drop("results")
    joined = rows.join(stats, ["brand", "model", "year", "mileage", "exclude_hash"]).withColumn(
        "live_price", F.lit(None).cast("bigint")
    )
    return M.verdict(joined).select(
        "id", "market", "reference_price", "reference_label", "range_min", "range_max", "tone", "score",
        "fill_pct", P.half_up(F.col("marker_pct")).alias("marker_pct"), P.half_up(F.col("diff_pct")).alias("diff_pct"),
        "n_comparable",
    )


def peers(spark, d):
    rows = S.peers_in_auction(lots(spark, d)).select("id", F.posexplode("peers").alias("pos", "p"))
    return rows.select("id", (F.col("pos") + 1).alias("rank"), F.col("p.id").alias("peer_id"),
                       F.col("p.matches").alias("matches"))


def peer_stats(spark, d):
    return S.peer_stats(S.peers_in_auction(lots(spark, d)))


def auction_summary(spark, d):
    return M.auction_summary(lots(spark, d), ["auction_id"])


def city_summary(spark, d):
    return M.auction_summary(lots(spark, d), ["city"])


def city_counts(spark, d):
    return M.city_counts(lots(spark, d), ["auction_id"])


def tri_state(spark, d):
    """Lots by inspection state: present, missing, unknown."""
    return lots(spark, d).groupBy("city").agg(
        F.count_if(F.coalesce(F.col("ct_available"), F.lit(False))).alias("ct_ok"),
        F.count_if(~F.coalesce(F.col("ct_available"), F.lit(True))).alias("ct_missing"),
        F.count_if(F.col("ct_available").isNull()).alias("ct_unknown"),
    )


def cheapest(spark, d):
    return M.cheapest(lots(spark, d)).select("id", "starting_price", "status")


def not_drivable(spark, d):
    """Lots flagged by each of the three wordings."""
    obs = F.col("observations")
    return lots(spark, d).groupBy("city").agg(
        F.count_if(P.not_drivable("strict", obs)).alias("strict"),
        F.count_if(P.not_drivable("loose", obs, F.col("model"))).alias("loose"),
        F.count_if(P.not_drivable("comparable", obs, F.col("model"))).alias("comparable"),
    )


def margins(spark, d):
    sold, start, market = F.col("sold_price"), F.col("starting_price"), F.col("market_value")
    return lots(spark, d).filter(sold.isNotNull()).select(
        "id", P.margin(sold, start).alias("vs_start"), P.margin_pct(sold, start).alias("vs_start_pct"),
        P.margin(sold, market).alias("vs_market"), P.margin_pct(sold, market).alias("vs_market_pct"),
    )


def list_engagement(spark, d):
    summary = M.auction_summary(lots(spark, d), ["auction_id"]).select(
        "auction_id", "total", "sold", F.lit(0).alias("price_moves"), F.lit(0).alias("new_vehicles")
    )
    return M.list_engagement(summary).drop("price_moves", "new_vehicles")


def entity_engagement(spark, d):
    h = run(spark, d)
    found = B.badges(h.snap).groupBy("vehicle_id").agg(F.count("*").alias("badge_count"))
    rows = h.evolution.join(found, "vehicle_id", "left").select(
        "vehicle_id", F.lit(None).cast("bigint").alias("score"), F.lit(None).cast("string").alias("tone"),
        "total_passages", F.coalesce("badge_count", F.lit(0)).alias("badge_count"),
        F.when(F.col("last_passage_sold"), F.col("last_effective_price")).alias("sold_price"),
        F.lit(False).alias("is_new"),
    )
    return M.entity_engagement(rows).select("vehicle_id", "xp", "level", "next_level_xp", "streak", "good_deals")


def spec_terms(spark, d):
    """Trim level and normalised key of every entity's version and model."""
    return vehicles(spark, d).select(
        "id", X.trim_level(F.col("version")).alias("trim"), X.normalize_key(F.col("version")).alias("version_key"),
        X.first_word(F.col("model")).alias("word"),
        F.round(X.token_overlap(F.col("model"), F.concat_ws(" ", "model", "version")), 6).alias("model_overlap"),
        P.km_per_year(F.col("l_mileage"), F.col("year"), F.lit("2024-06-01").cast("date")).cast("bigint").alias("km_per_year"),
    )


def resolve(spark, d):
    records = load_view(spark, d, "fx_records")
    rows = I.resolve(records, vehicles(spark, d))
    return rows.select("id", "matched_by", "vehicle_id", "duplicate_id", "score", F.array_join("reasons", ",").alias("reasons"))


def _clusters(spark, d):
    items = vehicles(spark, d)
    return I.connected_components(I.duplicate_edges(items))


def clusters(spark, d):
    return _clusters(spark, d)


def merge_clusters(spark, d):
    return I.merge_mapping(vehicles(spark, d), _clusters(spark, d)).select("old_id", "new_id")


def cluster_summary(spark, d):
    mapping = I.merge_mapping(vehicles(spark, d), _clusters(spark, d))
    sales = load_view(spark, d, "fx_lots").select("vehicle_id")
    return I.cluster_summary(mapping, sales)


QUERIES = {
    f.__name__: f
    for f in [
        similarity, offers_elsewhere, offers_summary, same_model, same_model_avg, similar_sold,
        similar_sold_top, verdict, peers, peer_stats, auction_summary, city_summary, city_counts,
        tri_state, cheapest, not_drivable, margins, list_engagement, entity_engagement, spec_terms,
        resolve, clusters, merge_clusters, cluster_summary,
    ]
}

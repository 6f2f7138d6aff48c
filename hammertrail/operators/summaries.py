"""Auction summaries, price verdicts and engagement figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammertrail.functions import prices as P

# --- fixed values -----------------------------------------------------------
BAND = 8                      # percent around the market that counts as aligned
RANGE_LOW, RANGE_HIGH = 0.86, 1.16
AXIS_LOW, AXIS_HIGH = 0.92, 1.04
SCORE_BASE, SCORE_SLOPE, SCORE_MIN, SCORE_MAX = 64, 2.2, 10, 95
FILL_MIN, FILL_MAX = 14, 90
DEFAULT_SCORE = 42
# ----------------------------------------------------------------------------


def auction_summary(lots: DataFrame, by: list[str]) -> DataFrame:
    """Totals, prices, margins and sell-through per auction. 0 is "no price"."""
    status = F.col("status")
    sold, unsold = status == "sold", status == "unsold"
    price = P.known(F.col("sold_price"))
    start = P.known(F.col("starting_price"))
    out = lots.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(sold).alias("sold"),
        F.count_if(unsold).alias("unsold"),
        F.count_if(P.not_drivable("loose", F.col("observations"), F.col("model"))).alias("not_drivable"),
        F.coalesce(F.sum(F.when(sold, price)), F.lit(0)).alias("revenue"),
        F.coalesce(P.half_up(F.avg(F.when(sold, price))), F.lit(0)).alias("avg_sold"),
        F.coalesce(F.min(start), F.lit(0)).alias("min_start"),
        F.coalesce(F.max(start), F.lit(0)).alias("max_start"),
        F.coalesce(P.half_up(F.avg(F.when(sold, price - start))), F.lit(0)).alias("avg_margin"),
        F.count_if(F.coalesce(F.col("ct_available"), F.lit(False))).alias("ct_ok"),
        F.count_if(~F.coalesce(F.col("ct_available"), F.lit(True))).alias("ct_missing"),
    )
    return out.withColumn("available", F.col("total") - F.col("sold") - F.col("unsold")).withColumn(
        "sell_through", P.half_up(F.col("sold") * 100 / F.col("total"))
    )


def city_counts(lots: DataFrame, by: list[str]) -> DataFrame:
    known = lots.filter(F.coalesce("city", F.lit("")) != "")
    return known.groupBy(*by, "city").agg(F.count("*").alias("n"))


def cheapest(lots: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` cheapest lots; a missing price sorts as 0."""
    return lots.orderBy(F.coalesce("starting_price", F.lit(0)), "id").limit(k)


def verdict(rows: DataFrame) -> DataFrame:
    """Deal verdict of each row against its market.

    Needs sold_price, live_price, starting_price, market_value and the
    comparables n_comparable, avg_sold, min_sold, max_sold. Rows without any
    market reference are left out.
    """
    market = F.coalesce(P.known(F.col("avg_sold")), P.known(F.col("market_value")))
    rows = rows.withColumn("market", market).filter(F.col("market").isNotNull())
    m, start = F.col("market"), F.col("starting_price")
    rows = rows.withColumn("reference_price", F.coalesce("sold_price", "live_price", "starting_price", "market"))
    ref = F.col("reference_price")
    label = (
        F.when(P.known(F.col("sold_price")).isNotNull(), F.lit("ADJUGE"))
        .when(P.known(F.col("live_price")).isNotNull(), F.lit("ENCHERE LIVE"))
        .when(P.known(start).isNotNull(), F.lit("MISE A PRIX"))
        .otherwise(F.lit("REFERENCE"))
    )
    rows = (
        rows.withColumn("reference_label", label)
        .withColumn("range_min", F.coalesce("min_sold", P.half_up(m * RANGE_LOW)))
        .withColumn("range_max", F.coalesce("max_sold", P.half_up(m * RANGE_HIGH)))
        .withColumn("_low", F.least("range_min", F.coalesce(start, ref), m) * AXIS_LOW)
        .withColumn("_high", F.greatest("range_max", F.coalesce(start, ref), m) * AXIS_HIGH)
        .withColumn("diff_pct", (ref - m) * 100.0 / m)
    )
    diff = F.col("diff_pct")
    tone = F.when(diff <= -BAND, F.lit("good")).when(diff >= BAND, F.lit("bad")).otherwise(F.lit("warn"))
    score = F.least(F.lit(SCORE_MAX), F.greatest(F.lit(SCORE_MIN), P.half_up(SCORE_BASE - diff * SCORE_SLOPE)))
    haircut = F.when(F.col("tone") == "good", 4).when(F.col("tone") == "bad", 18).otherwise(10)
    span = F.greatest(F.col("_high") - F.col("_low"), F.lit(1.0))
    return (
        rows.withColumn("tone", tone)
        .withColumn("score", score)
        .withColumn("fill_pct", F.least(F.lit(FILL_MAX), F.greatest(F.lit(FILL_MIN), F.col("score") - haircut)))
        .withColumn("marker_pct", (ref - F.col("_low")) / span * 100)
        .drop("_low", "_high")
    )


def _levels(rows: DataFrame, xp: Column, step: int) -> DataFrame:
    level = F.greatest(F.lit(1), F.floor(F.col("xp") / step) + 1)
    return rows.withColumn("xp", xp).withColumn("level", level.cast("bigint")).withColumn(
        "next_level_xp", F.col("level") * step
    )


def list_engagement(summary: DataFrame) -> DataFrame:
    """Experience, level and streak of a list.

    Needs total, sold, price_moves and new_vehicles.
    """
    total, moves = F.col("total"), F.col("price_moves")
    xp = F.greatest(F.lit(50), total * 5 + F.col("sold") * 14 + moves * 18 + F.col("new_vehicles") * 12)
    streak = F.greatest(F.lit(1), F.least(F.lit(12), F.ceil(total / 8) + F.least(F.lit(4), moves)))
    return _levels(summary, xp, 35).withColumn("streak", streak.cast("bigint")).withColumn(
        "good_deals", F.greatest(F.lit(1), F.col("sold") + F.col("new_vehicles"))
    )


def entity_engagement(rows: DataFrame) -> DataFrame:
    """Experience, level and streak of an entity.

    Needs score and tone (NULL without verdict), total_passages, badge_count,
    sold_price and is_new.
    """
    score = F.coalesce("score", F.lit(DEFAULT_SCORE))
    n, badges = F.col("total_passages"), F.col("badge_count")
    good = F.coalesce(F.col("tone") == "good", F.lit(False))
    xp = F.greatest(
        F.lit(90),
        score * 3 + n * 18 + badges * 12
        + F.when(P.known(F.col("sold_price")).isNotNull(), 24).otherwise(0)
        + F.when(F.col("is_new"), 18).otherwise(0),
    )
    streak = F.greatest(
        F.lit(1), F.least(F.lit(12), n + F.when(good, 2).otherwise(0) + F.least(F.lit(3), badges))
    )
    return _levels(rows, xp, 30).withColumn("streak", streak.cast("bigint")).withColumn(
        "good_deals", F.greatest(F.lit(1), P.half_up((score + badges * 10) / 22))
    )

"""Price history points and price evolution per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammertrail.operators.passages import PASSAGE

# --- fixed values -----------------------------------------------------------
# Labels of chart points: single passage, or passage n of several.
LABEL_MAP, LABEL_MAP_MOVED = "Mise à prix", "Mise à prix ajustée"
LABEL_LIVE, LABEL_SOLD = "Enchère en cours", "Adjugé"
# ----------------------------------------------------------------------------


def evolution(passages: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """First and last price, amount and direction over an entity's passages."""
    no = F.col("passage_no")

    def first_of(value: Column) -> Column:
        return F.min(F.when(value.isNotNull(), F.struct(no, value.alias("v"))))["v"]

    last_price = F.coalesce("sold_price", "live_price", "starting_price")
    last = F.max(
        F.struct(
            no, last_price.alias("price"),
            ((F.col("status") == "sold") & F.col("sold_price").isNotNull()).alias("sold"),
        )
    )
    head = F.min(F.struct(no, F.when(F.col("traj_moves"), F.col("traj_first")).alias("v")))
    facts = passages.groupBy(entity).agg(
        F.count("*").alias("total_passages"),
        F.count_if(F.col("status") == "sold").alias("sold_count"),
        F.count_if(F.col("status") == "unsold").alias("unsold_count"),
        F.coalesce(head["v"], first_of(F.col("starting_price"))).alias("first_starting_price"),
        first_of(F.col("live_first")).alias("_live"),
        last.alias("_last"),
    )
    amount = F.col("last_effective_price") - F.coalesce("first_starting_price", "_live")
    return (
        facts.withColumn("last_effective_price", F.col("_last.price"))
        .withColumn("last_passage_sold", F.col("_last.sold"))
        .withColumn("evolution_amount", amount)
        .withColumn(
            "evolution_direction",
            F.when(F.col("evolution_amount") > 0, F.lit("up"))
            .when(F.col("evolution_amount") < 0, F.lit("down"))
            .when(F.col("evolution_amount") == 0, F.lit("stable"))
            .otherwise(F.lit("unknown")),
        )
        .drop("_live", "_last")
    )


def price_history(
    passages: DataFrame, starts: DataFrame, lives: DataFrame, entity: str = "vehicle_id"
) -> DataFrame:
    """Chart points: starting prices, live bids, sale, per passage in order.

    ``starts`` and ``lives`` are the trajectories of the same passages.
    ``kind`` orders the three groups inside a passage.
    """
    key = [entity, *PASSAGE]
    totals = passages.groupBy(entity).agg(F.count("*").alias("_total"))
    base = passages.join(totals, entity).select(
        *key, "passage_no", "date", "starting_price", "sold_price", "traj_moves",
        (F.col("_total") > 1).alias("_many"),
    )
    tag = F.concat(F.lit(" P"), F.col("passage_no").cast("string"))

    moved = base.filter("traj_moves").join(
        starts.select(*key, "pos", F.col("starting_price").alias("price")), key
    )
    flat = base.filter(~F.col("traj_moves") & F.col("starting_price").isNotNull()).select(
        "*", F.lit(1).cast("bigint").alias("pos"), F.col("starting_price").alias("price")
    )
    map_label = F.when(
        F.col("_many"),
        F.concat(F.lit("MAP"), tag, F.when(F.col("pos") > 1, F.lit(" (ajusté)")).otherwise(F.lit(""))),
    ).otherwise(F.when(F.col("pos") > 1, F.lit(LABEL_MAP_MOVED)).otherwise(F.lit(LABEL_MAP)))
    map_points = moved.unionByName(flat).select("*", F.lit(1).alias("kind"), map_label.alias("label"))

    bid_counts = lives.groupBy(*key).agg(F.count("*").alias("_bids"))
    bids = (
        base.join(lives.select(*key, "pos", F.col("live_price").alias("price")), key)
        .join(bid_counts, key)
        .filter(
            ~F.col("price").eqNullSafe(F.col("starting_price"))
            & ~F.col("price").eqNullSafe(F.col("sold_price"))
        )
    )
    nth = F.when(F.col("_bids") > 1, F.concat(F.lit(" #"), F.col("pos").cast("string"))).otherwise(F.lit(""))
    live_label = F.when(F.col("_many"), F.concat(F.lit("Enchère"), tag, nth)).otherwise(
        F.concat(F.lit(LABEL_LIVE), nth)
    )
    live_points = bids.withColumn("kind", F.lit(2)).withColumn("label", live_label).drop("_bids")

    sold_label = F.when(F.col("_many"), F.concat(F.lit(LABEL_SOLD), tag)).otherwise(F.lit(LABEL_SOLD))
    sold_points = base.filter(F.col("sold_price").isNotNull()).select(
        "*", F.lit(1).cast("bigint").alias("pos"), F.col("sold_price").alias("price"),
        F.lit(3).alias("kind"), sold_label.alias("label"),
    )
    return (
        map_points.unionByName(live_points).unionByName(sold_points)
        .select(entity, "passage_no", "kind", "pos", "date", "price", "label")
    )


def series_summary(points: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Range and movement of a price history with at least two points."""
    at = F.struct("passage_no", "kind", "pos", "price")
    return (
        points.groupBy(entity).agg(
            F.count("*").alias("n_points"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            F.min(at)["price"].alias("first_price"),
            F.max(at)["price"].alias("last_price"),
        )
        .filter(F.col("n_points") >= 2)
        .withColumn("diff", F.col("last_price") - F.col("first_price"))
    )


def patch_latest(passages: DataFrame, current: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Fill the price of the latest passage in the current city when unknown.

    ``current`` has one row per entity: city and resolved_price. Only the most
    recent passage of that city is filled, and only if it has no price.
    """
    now = current.select(
        entity, F.coalesce("city", F.lit("")).alias("_city"), F.col("resolved_price").alias("_price")
    )
    rows = passages.join(now, entity, "left")
    here = F.coalesce(F.col("city"), F.lit("")) == F.col("_city")
    latest = (
        rows.filter(here).groupBy(entity).agg(F.max("passage_no").alias("passage_no"))
        .withColumn("_latest", F.lit(True))
    )
    rows = rows.join(latest, [entity, "passage_no"], "left")
    patch = F.coalesce("_latest", F.lit(False)) & F.col("starting_price").isNull() & (F.col("_price") > 0)
    return (
        rows.withColumn("patched", F.coalesce(patch, F.lit(False)))
        .withColumn("starting_price", F.when(F.col("patched"), F.col("_price")).otherwise(F.col("starting_price")))
        .drop("_city", "_price", "_latest")
    )

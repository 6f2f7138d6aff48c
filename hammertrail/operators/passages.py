"""Passages: the appearances of an entity at auctions, rebuilt from snapshots.

Input rows need: id, scraped_at, status, sale_date, hash_id, city and the
price columns; ``entity`` names the entity key. All work is grouping and joins
on keys that contain the calendar day, so one hot entity spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammertrail.functions import prices as P
from hammertrail.functions.text import blank_to_null, order_date
from hammertrail.functions.urls import normalize_url
from hammertrail.operators.ordering import positions, with_previous
from hammertrail.session import cut_lineage

PASSAGE = ["bucket", "seq"]

# Columns of the canonical snapshot that a passage takes over as they are.
CANONICAL = ["status", "city", "source_url", "hash_id", "sale_date", "sold_price", "scraped_at"]
# Columns filled from the first snapshot of the chain that knows them.
FIRST_KNOWN = ["sale_time", "center", "lot_number", "observations", "technical_check_url"]
# Columns of the canonical snapshot taken over where the log has them.
OPTIONAL = ["photo_urls", "has_screenshot"]
# Columns that the number, the status and the prices of passages depend on.
PRICED = [
    "id", "vehicle_id", "reference", "hash_id", "city", "status", "sale_date", "scraped_at", "starting_price", "live_price",
    "sold_price", "market_value", "new_price", "mileage",
]

# --- fixed values -----------------------------------------------------------
OPEN_STABLE = "URL historique stable"
OPEN_REUSED = "URL réutilisée par un passage ultérieur"
OPEN_INTERMEDIATE = "Snapshot intermédiaire d’un même passage"
OPEN_UNAVAILABLE = "URL historique indisponible"
# ----------------------------------------------------------------------------


def bucket_key(hash_id: Column, city: Column, ordered_on: Column) -> Column:
    """Listing identity: the hash, or place and date for rows without one."""
    located = F.concat_ws("|", F.lit("loc"), F.coalesce(blank_to_null(city), F.lit("unknown")), ordered_on)
    return F.when(
        blank_to_null(hash_id).isNotNull(), F.concat(F.lit("hash|"), hash_id)
    ).otherwise(located)


def passage_key(city: Column, sale_date: Column, ts: Column) -> Column:
    """Place and date of one appearance."""
    return F.concat_ws(
        "|", F.coalesce(blank_to_null(city), F.lit("unknown")), order_date(sale_date, ts)
    )


def sessionise(snap: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Add ``bucket``, ``ord_date``, ``bucket_first`` and ``seq`` to snapshots.

    A listing starts a new passage at the first snapshot whose sale date lies
    after a date on which the listing was already sold or unsold. Sale dates
    do not decrease along a chain ordered by (date, scrape time, id), so the
    rule depends only on the distinct dates of a listing: a dated day opens a
    passage exactly when the dated day before it saw a final status. The
    snapshots are therefore reduced to one row per listing and day, the rule
    is a window over those days, and the result is joined back.
    """
    return place(snap, listing_days(snap, entity), entity)


def _listed(snap: DataFrame) -> DataFrame:
    return (
        snap.withColumn("ord_date", order_date(F.col("sale_date"), F.col("scraped_at")))
        .withColumn("bucket", bucket_key(F.col("hash_id"), F.col("city"), F.col("ord_date")))
        .withColumn("_pos", F.struct("scraped_at", "id"))
    )


def listing_days(snap: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """One row per listing and day with the passage it falls into, see :func:`sessionise`."""
    rows = _listed(snap)
    dated = blank_to_null(F.col("sale_date")).isNotNull()
    days = rows.groupBy(entity, "bucket", "ord_date").agg(
        F.min("_pos").alias("_first"),
        F.min(F.when(dated, F.col("_pos"))).alias("_first_dated"),
        F.bool_or(dated & P.is_terminal(F.col("status"))).alias("_closed"),
    )
    by_day = Window.partitionBy(entity, "bucket").orderBy("ord_date")
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    is_dated = F.col("_first_dated").isNotNull()
    closed_before = F.last(F.when(is_dated, F.col("_closed")), ignorenulls=True).over(earlier)
    return (
        days.withColumn("_opens", (is_dated & F.coalesce(closed_before, F.lit(False))).cast("int"))
        .withColumn("_seq", F.sum("_opens").over(by_day))
        .withColumn("bucket_first", F.min("_first").over(Window.partitionBy(entity, "bucket")))
        .select(entity, "bucket", "ord_date", "_first_dated", "_opens", "_seq", "bucket_first")
    )


def place(snap: DataFrame, days: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Snapshots with the passage of their listing and day, see :func:`sessionise`."""
    # Undated rows scraped before the first dated row of the day stay behind it.
    behind = F.col("_first_dated").isNotNull() & (F.col("_pos") < F.col("_first_dated"))
    return (
        _listed(snap).join(days, [entity, "bucket", "ord_date"])
        .withColumn("seq", F.col("_seq") - F.when(behind, F.col("_opens")).otherwise(F.lit(0)))
        .drop("_pos", "_first_dated", "_opens", "_seq")
    )


def _seen(name: str, keep: Column) -> Column:
    """Kept value under its scrape time: min is the earliest, max the latest."""
    return F.when(keep, F.struct("scraped_at", "id", F.col(name).alias("v")))


def _in_chain(name: str, keep: Column) -> Column:
    """Kept value under its place in the chain: min is the first."""
    return F.when(keep, F.struct("ord_date", "scraped_at", "id", F.col(name).alias("v")))


def _facts(chained: DataFrame, entity: str) -> DataFrame:
    """One row per passage with every aggregate a passage needs.

    The snapshots are shuffled once, into cells of (passage, sale date,
    starting price). All aggregates are minima, maxima and sums, which merge
    from cells to passages, and the most frequent date and price are counted
    from the cells. Cells and facts are written once because several steps
    read them.
    """
    price, live = F.col("starting_price"), F.col("live_price")
    presale = P.is_presale(F.col("status")) & price.isNotNull()
    real = presale & (price != P.PLACEHOLDER)
    bid = F.coalesce(live, F.lit(0)) > 0
    payload = [c for c in CANONICAL if c != "scraped_at" and c in chained.columns]
    payload += [c for c in OPTIONAL if c in chained.columns]
    known = [c for c in FIRST_KNOWN if c in chained.columns]
    canon = F.struct(
        F.col("sold_price").isNull().alias("_unsold"),
        (-F.unix_micros("scraped_at")).alias("_age"),
        "ord_date", "id", *payload, *known, "mileage", "scraped_at",
    )
    aggs = {
        "canon": (F.min, canon),
        "bucket_first": (F.min, F.col("bucket_first")),
        "first_map": (F.min, _seen("starting_price", presale)),
        "last_map": (F.max, _seen("starting_price", presale)),
        "first_real": (F.min, _seen("starting_price", real)),
        "last_real": (F.max, _seen("starting_price", real)),
        "min_map": (F.min, F.when(presale, price)),
        "max_map": (F.max, F.when(presale, price)),
        "min_real": (F.min, F.when(real, price)),
        "max_real": (F.max, F.when(real, price)),
        "first_live": (F.min, _seen("live_price", bid)),
        "last_live": (F.max, _seen("live_price", bid)),
        "max_live": (F.max, live),
        "max_sold": (F.max, F.col("sold_price")),
        "max_market": (F.max, F.col("market_value")),
        "max_new": (F.max, F.col("new_price")),
        "first_mileage": (F.min, _in_chain("mileage", F.col("mileage") > 0)),
        "cell_at": (F.min, F.struct("ord_date", "scraped_at", "id")),
    }
    for name in known:
        aggs["first_" + name] = (F.min, _in_chain(name, F.col(name).isNotNull()))
    cell = [entity, *PASSAGE]
    cells = cut_lineage(
        chained.groupBy(
            *cell, blank_to_null(F.col("sale_date")).alias("_date"), price.alias("_price")
        ).agg(
            F.count("*").alias("n_snapshots"),
            *[f(expr).alias(name) for name, (f, expr) in aggs.items()],
        )
    )
    facts = cells.groupBy(*cell).agg(
        F.sum("n_snapshots").alias("n_snapshots"),
        *[f(name).alias(name) for name, (f, _) in aggs.items()],
    )
    dates = (
        cells.filter(F.col("_date").isNotNull())
        .groupBy(*cell, "_date").agg(F.sum("n_snapshots").alias("_n"))
        .groupBy(*cell).agg(F.max(F.struct("_n", "_date"))["_date"].alias("mode_date"))
    )
    rank = F.struct((-F.col("_n")).alias("n"), "_at", F.col("_price").alias("v"))
    modes = (
        cells.filter(F.col("_price").isNotNull())
        .groupBy(*cell, "_price")
        .agg(F.sum("n_snapshots").alias("_n"), F.min("cell_at").alias("_at"))
        .groupBy(*cell)
        .agg(
            F.min(rank)["v"].alias("mode_any"),
            F.min(F.when(F.col("_price") != P.PLACEHOLDER, rank))["v"].alias("mode_real"),
        )
    )
    return cut_lineage(facts.join(dates, cell, "left").join(modes, cell, "left"))


def entity_evidence(df: DataFrame, entity: str) -> DataFrame:
    """Strongest signal per entity (0 reads as NULL) and the verdict on 100."""
    signals = {c: F.nullif(F.max(c), F.lit(0)) for c in ["max_live", "max_sold", "max_market", "max_new"]}
    out = df.groupBy(entity).agg(*[v.alias("e_" + k[4:]) for k, v in signals.items()])
    return out.withColumn(
        "disproved", P.disproves_placeholder(*[F.col(f"e_{c}") for c in ["live", "sold", "market", "new"]])
    )


def snapshot_evidence(snap: DataFrame, entity: str) -> DataFrame:
    """``entity_evidence`` straight from snapshots."""
    renamed = snap.select(
        entity,
        F.col("live_price").alias("max_live"),
        F.col("sold_price").alias("max_sold"),
        F.col("market_value").alias("max_market"),
        F.col("new_price").alias("max_new"),
    )
    return entity_evidence(renamed, entity)


def build_passages(chained: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """One row per passage, numbered per entity from the oldest.

    ``chained`` comes from :func:`sessionise`.
    """
    facts = _facts(chained, entity)
    facts = facts.join(entity_evidence(facts, entity), entity)
    canon = F.col("canon")

    def clean(kind_any: str, kind_real: str) -> Column:
        return F.when(F.col("disproved"), F.col(kind_real)).otherwise(F.col(kind_any))

    known = [c for c in FIRST_KNOWN if "first_" + c in facts.columns]
    optional = [c for c in OPTIONAL if c in chained.columns]
    date = F.coalesce("mode_date", canon["ord_date"])
    rows = facts.select(
        entity, *PASSAGE, "bucket_first",
        date.alias("date"),
        canon["id"].alias("snapshot_id"),
        *[canon[c].alias(c) for c in ["status", "city", "source_url", "hash_id", "scraped_at"] if c in chained.columns],
        *[F.coalesce(canon[c], F.col("first_" + c)["v"]).alias(c) for c in known],
        *[canon[c].alias(c) for c in optional],
        F.coalesce(
            clean("last_map", "last_real")["v"], clean("mode_any", "mode_real")
        ).alias("starting_price"),
        F.col("last_live")["v"].alias("live_price"),
        canon["sold_price"].alias("sold_price"),
        F.coalesce(P.known(canon["mileage"]), F.col("first_mileage")["v"], F.lit(0)).alias("mileage"),
        clean("first_map", "first_real")["v"].alias("traj_first"),
        F.coalesce(
            clean("min_map", "min_real") != clean("max_map", "max_real"), F.lit(False)
        ).alias("traj_moves"),
        F.col("first_live")["v"].alias("live_first"),
        "n_snapshots", "disproved",
        clean("mode_any", "mode_real").alias("mode_price"),
        clean("last_map", "last_real")["v"].alias("presale_price"),
        "e_live", "e_sold", "e_market", "e_new",
    )
    return positions(
        rows, [entity], F.col("date"), [F.col("date"), F.col("bucket_first"), F.col("seq")], "passage_no"
    )


def passage_numbers(chained: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """(entity, bucket, seq, passage_no) as :func:`build_passages` numbers them, without any other fact of a passage."""
    canon = F.struct(F.col("sold_price").isNull().alias("_unsold"), (-F.unix_micros("scraped_at")).alias("_age"), "ord_date", "id")
    cells = chained.groupBy(entity, *PASSAGE, blank_to_null(F.col("sale_date")).alias("_date")).agg(
        F.count("*").alias("_n"), F.min(canon).alias("canon"), F.min("bucket_first").alias("bucket_first")
    )
    mode = F.max(F.when(F.col("_date").isNotNull(), F.struct("_n", "_date")))["_date"]
    rows = cells.groupBy(entity, *PASSAGE).agg(
        F.coalesce(mode, F.min("canon")["ord_date"]).alias("date"), F.min("bucket_first").alias("bucket_first")
    )
    order = [F.col("date"), F.col("bucket_first"), F.col("seq")]
    return positions(rows, [entity], F.col("date"), order, "passage_no").select(entity, *PASSAGE, "passage_no")


def final_sale_cut(passages: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Add ``cutoff`` (latest sold date) and ``truncated`` (strictly later)."""
    cutoff = passages.filter(F.col("status") == "sold").groupBy(entity).agg(F.max("date").alias("cutoff"))
    return passages.join(cutoff, entity, "left").withColumn(
        "truncated", F.coalesce(F.col("date") > F.col("cutoff"), F.lit(False))
    )


def navigation(passages: DataFrame, entity: str = "vehicle_id", external: str = "external") -> DataFrame:
    """How to open each passage: its own page while no later passage reuses it."""
    rows = passages.withColumn("_url", normalize_url(F.col("source_url")))
    last_hash = (
        rows.filter(blank_to_null(F.col("hash_id")).isNotNull())
        .groupBy(entity, "hash_id").agg(F.max("passage_no").alias("_last_hash"))
    )
    last_url = (
        rows.filter(F.col("_url") != "").groupBy(entity, "_url").agg(F.max("passage_no").alias("_last_url"))
    )
    rows = rows.join(last_hash, [entity, "hash_id"], "left").join(last_url, [entity, "_url"], "left")
    reused = F.coalesce(
        F.greatest("_last_hash", "_last_url") > F.col("passage_no"), F.lit(False)
    )
    has_url = F.coalesce(F.col("source_url"), F.lit("")) != ""
    stable = has_url & ~reused
    reason = (
        F.when(~has_url, F.lit(OPEN_UNAVAILABLE))
        .when(reused, F.lit(OPEN_REUSED))
        .otherwise(F.lit(OPEN_STABLE))
    )
    return (
        rows.withColumn("is_stable", stable)
        .withColumn("open_mode", F.when(stable, F.lit(external)).otherwise(F.lit("local")))
        .withColumn("open_reason", reason)
        .drop("_url", "_last_hash", "_last_url")
    )


def scrubbed(price: Column, disproved: Column) -> Column:
    return F.when(~(disproved & price.eqNullSafe(F.lit(P.PLACEHOLDER))), price)


def _steps(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` differs from the one before, numbered from 1."""
    order = [F.col("scraped_at"), F.col("id")]
    chunk = F.to_date("scraped_at")
    # Written once: the search for hot days and the windows both read it.
    moved = with_previous(cut_lineage(rows), keys, chunk, order, F.struct(value), "_prev").filter(
        F.col("_prev").isNull() | ~F.col(f"_prev.{value}").eqNullSafe(F.col(value))
    )
    return positions(cut_lineage(moved.drop("_prev")), keys, chunk, order, "pos")


def price_trajectory(chained: DataFrame, evidence: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Consecutive distinct starting prices before the sale, oldest first."""
    rows = (
        chained.filter(P.is_presale(F.col("status")) & F.col("starting_price").isNotNull())
        .join(evidence.select(entity, "disproved"), entity)
        .filter(scrubbed(F.col("starting_price"), F.col("disproved")).isNotNull())
        .select(entity, *PASSAGE, "scraped_at", "id", "starting_price")
    )
    return _steps(rows, [entity, *PASSAGE], "starting_price")


def live_trajectory(chained: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Consecutive distinct live bids, oldest first; revisited values stay."""
    rows = chained.filter(F.col("live_price") > 0).select(
        entity, *PASSAGE, "scraped_at", "id", "live_price"
    )
    return _steps(rows, [entity, *PASSAGE], "live_price")


EVENT_FIELDS = [
    "starting_price", "live_price", "sold_price", "status", "sale_date", "sale_time",
    "mileage", "source_url",
]


def compress_events(chained: DataFrame, evidence: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Snapshots at which any of the event fields changed, first one included.

    Equality on all fields is transitive, so comparing with the row before is
    the same as comparing with the last row kept.
    """
    rows = (
        chained.join(evidence.select(entity, "disproved"), entity)
        .withColumn("starting_price", scrubbed(F.col("starting_price"), F.col("disproved")))
        .select(entity, *PASSAGE, "scraped_at", "id", *EVENT_FIELDS)
    )
    fields = F.struct(*EVENT_FIELDS)
    order = [F.col("scraped_at"), F.col("id")]
    paired = with_previous(cut_lineage(rows), [entity, *PASSAGE], F.to_date("scraped_at"), order, fields, "_prev")
    same = F.lit(True)
    for name in EVENT_FIELDS:
        same = same & F.col(name).eqNullSafe(F.col(f"_prev.{name}"))
    return paired.filter(F.col("_prev").isNull() | ~same).drop("_prev")


def event_navigation(events: DataFrame, navigated: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Give each event its opening mode; only the canonical one may open out."""
    canon = navigated.select(entity, *PASSAGE, "passage_no", "snapshot_id", "open_mode", "open_reason")
    is_canon = F.col("id") == F.col("snapshot_id")
    return (
        events.join(canon, [entity, *PASSAGE])
        .withColumn("event_mode", F.when(is_canon, F.col("open_mode")).otherwise(F.lit("local")))
        .withColumn(
            "event_reason", F.when(is_canon, F.col("open_reason")).otherwise(F.lit(OPEN_INTERMEDIATE))
        )
        .drop("open_mode", "open_reason")
    )


def passage_key_count(snap: DataFrame, entity: str = "vehicle_id") -> DataFrame:
    """Distinct place-and-date keys per entity."""
    key = passage_key(F.col("city"), F.col("sale_date"), F.col("scraped_at"))
    return (
        snap.select(entity, key.alias("_key")).distinct()
        .groupBy(entity).agg(F.count("*").alias("passage_count"))
    )


def is_current(passage: dict[str, Column], snap: dict[str, Column]) -> Column:
    """Whether a passage is the auction a snapshot was taken in."""

    def same_if_known(a: Column, b: Column) -> Column:
        return F.coalesce(a == b, F.lit(True))

    same_city = F.coalesce(passage["city"], F.lit("")) == F.coalesce(snap["city"], F.lit(""))
    now_date = order_date(snap["sale_date"], snap["scraped_at"])
    return (
        F.coalesce(same_city & (passage["date"] == now_date), F.lit(False))
        & same_if_known(blank_to_null(passage["center"]), blank_to_null(snap["center"]))
        & same_if_known(passage["lot_number"], snap["lot_number"])
    )

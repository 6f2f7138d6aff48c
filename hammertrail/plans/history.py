"""History of every entity: passages, prices, evolution, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammertrail.functions import prices as P
from hammertrail.functions.text import blank_to_null
from hammertrail.operators import evolution as E
from hammertrail.operators import lookups as L
from hammertrail.operators import passages as S
from hammertrail.operators.ordering import latest_by
from hammertrail.session import cut_lineage


class History:
    """The steps of one history run, each built once and shared.

    ``snap`` holds the snapshots with the entity key ``entity``.
    """

    def __init__(self, snap: DataFrame, entity: str = "vehicle_id"):
        self.entity = entity
        self.snap = snap
        self._cache: dict[str, DataFrame] = {}

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def chained(self) -> DataFrame:
        return self._once("chained", lambda: S.sessionise(self.snap, self.entity))

    @property
    def shared(self) -> DataFrame:
        """``chained``, written once for the runs that read it several times."""
        if "shared" not in self._cache:
            # Whatever is built from here on, the passages among it, reads the written copy.
            self._cache["shared"] = self._cache["chained"] = cut_lineage(self.chained)
        return self._cache["shared"]

    @property
    def passages(self) -> DataFrame:
        """Passages with number, cutoff and navigation, written once."""
        return self._once(
            "passages",
            lambda: cut_lineage(
                S.navigation(
                    S.final_sale_cut(S.build_passages(self.chained, self.entity), self.entity), self.entity
                )
            ),
        )

    @property
    def priced(self) -> DataFrame:
        """Passages with their numbers, status and prices only, written once; no later step is made for their pages."""
        cols = [
            self.entity, *S.PASSAGE, "passage_no", "date", "status", "starting_price", "live_price", "sold_price", "traj_first",
            "traj_moves", "live_first", "truncated",
        ]
        return self._once(
            "priced", lambda: cut_lineage(S.final_sale_cut(S.build_passages(self.chained, self.entity), self.entity).select(*cols))
        )

    @property
    def kept(self) -> DataFrame:
        return self.passages.filter(~F.col("truncated"))

    @property
    def evidence(self) -> DataFrame:
        return self._once("evidence", lambda: S.snapshot_evidence(self.snap, self.entity))

    @property
    def starts(self) -> DataFrame:
        return self._once(
            "starts", lambda: S.price_trajectory(self.shared, self.evidence, self.entity)
        )

    @property
    def lives(self) -> DataFrame:
        return self._once("lives", lambda: S.live_trajectory(self.shared, self.entity))

    @property
    def events(self) -> DataFrame:
        return S.event_navigation(
            S.compress_events(self.shared, self.evidence, self.entity), self.passages, self.entity
        )

    @property
    def evolution(self) -> DataFrame:
        return E.evolution(self.kept, self.entity)

    @property
    def price_history(self) -> DataFrame:
        starts, lives = self.starts, self.lives
        return E.price_history(self.kept, starts, lives, self.entity)


def identity_history(entities: DataFrame, snap: DataFrame, newest_first: bool = False) -> tuple[DataFrame, History]:
    """Entities with their history reference, and the history by identity.

    Snapshots count for an entity through its id, reference or hash.
    """
    # Written once: each way to a snapshot, and most results, read it.
    named = cut_lineage(L.history_reference(entities, snap, newest_first))
    return named, History(L.identity_union(named, snap), "entity_id")


def history_summary(entities: DataFrame, snap: DataFrame) -> DataFrame:
    """One flat row per entity: identity, counts and evolution; snapshots are read without the facts of their pages."""
    # Written once, since the entity, the reference and the hash each lead to snapshots by a join of their own.
    named, run = identity_history(entities, cut_lineage(snap.select(*S.PRICED)))
    evolution = E.evolution(run.priced.filter(~F.col("truncated")), "entity_id")
    counts = run.priced.groupBy("entity_id").agg(
        F.count_if(~F.col("truncated")).alias("n_passages"),
        F.count_if(F.col("truncated")).alias("n_truncated"),
    )
    return (
        named.withColumnRenamed("id", "entity_id")
        .join(counts, "entity_id").join(evolution, "entity_id")
        .select(
            "entity_id", F.coalesce("reference", F.lit("")).alias("reference"),
            F.coalesce("hash_id", F.lit("")).alias("hash_id"), "brand", "model", "year",
            "n_passages", "n_truncated", "sold_count", "unsold_count",
            "first_starting_price", "last_effective_price", "last_passage_sold",
            "evolution_amount", "evolution_direction",
        )
    )


def history_documents(entities: DataFrame, snap: DataFrame) -> DataFrame:
    """One nested document per entity, for export as JSON.

    Only passages, change events and price points are nested, never raw
    snapshots; the flat frames of :class:`History` are the form to query.
    """
    named, run = identity_history(entities, snap)
    events = run.events.groupBy("entity_id", "passage_no").agg(
        F.sort_array(
            F.collect_list(
                F.struct("scraped_at", F.col("id").alias("snapshot_id"), *S.EVENT_FIELDS, "event_mode", "event_reason")
            )
        ).alias("events")
    )
    passage = F.struct(
        "passage_no", "snapshot_id", "date", "sale_time", "city", "center", "status", "starting_price",
        "live_price", "sold_price", "mileage", "lot_number", "observations", "technical_check_url",
        "source_url", "is_stable", "open_mode", "open_reason", "events",
    )
    listed = run.passages.join(events, ["entity_id", "passage_no"], "left")
    nested = listed.groupBy("entity_id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("truncated"), passage))).alias("passages"),
        F.sort_array(F.collect_list(F.when(F.col("truncated"), passage))).alias("truncated_passages"),
        F.sort_array(
            F.collect_list(F.when(~F.col("truncated"), F.struct("passage_no", "date", "mileage")))
        ).alias("mileage_history"),
    )
    points = run.price_history.groupBy("entity_id").agg(
        F.sort_array(F.collect_list(F.struct("passage_no", "kind", "pos", "date", "price", "label"))).alias("price_history")
    )
    evolution = run.evolution.select("entity_id", F.struct(*[c for c in run.evolution.columns if c != "entity_id"]).alias("evolution"))
    identity = F.struct(
        F.coalesce("reference", F.lit("")).alias("reference"), F.coalesce("hash_id", F.lit("")).alias("hash_id"),
        "brand", "model", "version", "year",
    )
    return (
        named.withColumnRenamed("id", "entity_id")
        .join(nested, "entity_id").join(points, "entity_id", "left").join(evolution, "entity_id", "left")
        .select("entity_id", identity.alias("identity"), "passages", "truncated_passages",
                "price_history", "mileage_history", "evolution")
    )


def cross_auction(entities: DataFrame, snap: DataFrame) -> DataFrame:
    """Every passage of entities known by hash, with the first known price."""
    hashed = entities.filter(F.col("hash_id").isNotNull())
    named, run = identity_history(hashed, snap, newest_first=True)
    first = L.first_known_price(run.snap, "entity_id").withColumnRenamed("first_price", "first_starting_price")
    return run.passages.join(first, "entity_id", "left").select(
        "entity_id", "passage_no", "snapshot_id", "hash_id", "has_screenshot", "city",
        F.col("date").alias("sale_date"), "sale_time", "status", "starting_price", "sold_price",
        "lot_number", "mileage", "source_url", "is_stable", "open_mode", "open_reason", "truncated",
        "first_starting_price",
    )


def snapshot_view(snap: DataFrame) -> DataFrame:
    """For every snapshot: passage k of n within its own identity.

    The identity is the snapshot's entity, reference and hash. Identities that
    hold the same snapshots share one run: a reference or hash seen with one
    entity only adds nothing to that entity's own snapshots.
    """
    known = [F.col("vehicle_id"), blank_to_null(F.col("reference")).alias("reference"), blank_to_null(F.col("hash_id")).alias("hash_id")]

    def key(name: str):
        return F.to_json(F.struct(*known)).alias(name)

    marks = snap.select(*known).distinct()
    combos = marks.withColumn("_own", key("_own"))
    for mark in ("reference", "hash_id"):
        # NULL counts as an entity of its own.
        seen = marks.groupBy(mark).agg(F.count_distinct(F.struct("vehicle_id")).alias("_n")).filter(F.col(mark).isNotNull() & (F.col("_n") == 1))
        combos = combos.join(seen, mark, "left").withColumn(
            mark, F.when(F.col("_n").isNull() | F.col("vehicle_id").isNull(), F.col(mark))
        ).drop("_n")
    combos = cut_lineage(combos.withColumn("id", key("id")))
    runs = combos.select("id", F.col("vehicle_id").alias("_vehicle"), "reference", "hash_id").distinct()
    union = L.identity_union(runs, snap)
    days = cut_lineage(S.listing_days(union, "entity_id"))
    numbers = cut_lineage(S.passage_numbers(S.place(union, days, "entity_id"), "entity_id"))
    # A run holds all snapshots of its entity, so a snapshot is placed in the run of its own identity without the union.
    own = snap.filter(F.col("vehicle_id").isNotNull()).withColumn("_own", key("_own")).join(
        combos.select("_own", F.col("id").alias("entity_id")), "_own"
    )
    return L.locate_passage(S.place(own, days, "entity_id"), numbers, "entity_id").select(
        F.col("id").alias("snapshot_id"), "vehicle_id", "passage_no", "total_passages",
        "city", "center", "status", "sale_date", "sale_time",
    )


def resolved_prices(run: History, cards: DataFrame) -> DataFrame:
    """Current starting price per entity: own snapshot, list card, passages.

    Every candidate must be non-zero and no placeholder in the light of the
    entity's latest snapshot. ``cards`` has hash_id and card_price.
    """
    cols = ["starting_price", "live_price", "sold_price", "market_value", "new_price", "hash_id", "city", "status"]
    now = latest_by(run.snap, [run.entity], [F.col("scraped_at"), F.col("id")], [*cols, "scraped_at"])
    signals = [F.col(c) for c in ["live_price", "sold_price", "market_value", "new_price"]]

    def usable(price):
        return P.known(P.scrub_price(price, *signals))

    card = cards.groupBy("hash_id").agg(F.min("card_price").alias("_card"))
    placed = run.kept.select(run.entity, "passage_no", F.col("starting_price").alias("_p"))
    candidates = placed.join(now.select(run.entity, *[c for c in cols if c.endswith("price") or c == "market_value"]), run.entity)
    latest = candidates.filter(usable(F.col("_p")).isNotNull()).groupBy(run.entity).agg(
        F.max_by("_p", "passage_no").alias("_passage")
    )
    return (
        now.join(card, "hash_id", "left").join(latest, run.entity, "left")
        .withColumn(
            "resolved_price",
            F.coalesce(usable(F.col("starting_price")), usable(F.col("_card")), F.col("_passage")),
        )
        .drop("_card", "_passage")
    )


def headline(run: History, cards: DataFrame, visits: DataFrame) -> DataFrame:
    """Per entity: current prices, visits, earlier passages and margins.

    ``visits`` comes from ``visit_counts`` (key, visit_count).
    """
    now = resolved_prices(run, cards)
    seen = visits.select("visit_key", "visit_count")
    total = run.evolution.select(run.entity, "total_passages")
    return (
        now.withColumn("visit_key", F.concat(F.lit("vehicle:"), F.col(run.entity).cast("string")))
        .join(seen, "visit_key", "left").join(total, run.entity, "left")
        .select(
            run.entity, "status", "resolved_price", "live_price", "sold_price", "market_value",
            F.coalesce("visit_count", F.lit(0)).alias("visit_count"),
            F.greatest(F.coalesce("total_passages", F.lit(1)) - 1, F.lit(0)).alias("previous_passages"),
            P.margin(F.col("sold_price"), F.col("resolved_price")).alias("vs_start"),
            P.margin_pct(F.col("sold_price"), F.col("resolved_price")).alias("vs_start_pct"),
            P.margin(F.col("sold_price"), F.col("market_value")).alias("vs_market"),
            P.margin_pct(F.col("sold_price"), F.col("market_value")).alias("vs_market_pct"),
        )
    )

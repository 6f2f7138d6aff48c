"""Change detection between two snapshots, and reports over changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammertrail.functions import prices as P
from hammertrail.functions.text import fold

# --- fixed values -----------------------------------------------------------
FIELD_LABELS = {
    "starting_price": "Mise a prix",
    "sold_price": "Prix adjuge",
    "starting_price_ht": "Mise a prix HT",
    "market_value": "Cote",
    "mileage": "Kilometrage",
    "status": "Statut",
    "lot_number": "Numero de lot",
    "city": "Ville",
    "sale_date": "Date de vente",
    "observations": "Observations",
    "photos": "Photos",
}
PAGE_SIZE = 12
NEW_DETAIL = "Nouveau vehicule enregistre."
# ----------------------------------------------------------------------------


def _update(field: str, changed: Column, before: Column, after: Column, way: Column, delta: Column) -> Column:
    return F.when(
        changed,
        F.struct(
            F.lit(field).alias("field"), F.lit(FIELD_LABELS[field]).alias("label"),
            before.alias("before"), after.alias("after"), way.alias("direction"), delta.alias("delta"),
        ),
    )


def _money(field: str, old: Column, new: Column) -> Column:
    delta = P.number_delta(old, new)
    text = F.when(delta != 0, P.signed(delta, " €"))
    return _update(field, delta.isNotNull(), P.fmt_money(old), P.fmt_money(new), P.direction(delta), text)


def _text(field: str, changed: Column, before: Column, after: Column) -> Column:
    def shown(col: Column) -> Column:
        return F.coalesce(F.nullif(col, F.lit("")), F.lit(P.DASH))

    return _update(field, changed, shown(before), shown(after), F.lit("neutral"), F.lit(None).cast("string"))


def snapshot_diff(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Changed fields in display order as array<struct>.

    Both sides map field names to columns; ``photos`` is the photo count. One
    photo less is not a change.
    """

    def blank(col: Column) -> Column:
        return F.trim(F.coalesce(col, F.lit("")))

    km = P.number_delta(old["mileage"], new["mileage"])
    prev_status = F.coalesce(F.nullif(old["status"], F.lit("")), F.lit("available"))
    next_status = F.coalesce(F.nullif(new["status"], F.lit("")), F.lit("available"))
    no = "N°"
    photos = F.coalesce(new["photos"], F.lit(0)) - F.coalesce(old["photos"], F.lit(0))

    def photo_text(col: Column) -> Column:
        n = F.coalesce(col, F.lit(0))
        return F.concat(n.cast("string"), F.when(n > 1, F.lit(" photos")).otherwise(F.lit(" photo")))

    items = [
        *[_money(f, old[f], new[f]) for f in ["starting_price", "sold_price", "starting_price_ht", "market_value"]],
        _update(
            "mileage", F.coalesce(km != 0, F.lit(False)), P.fmt_km(old["mileage"]), P.fmt_km(new["mileage"]),
            P.direction(km), P.signed(km, " km"),
        ),
        _text("status", prev_status != next_status, P.status_label(prev_status), P.status_label(next_status)),
        _text(
            "lot_number", ~old["lot_number"].eqNullSafe(new["lot_number"]),
            F.concat(F.lit(no), old["lot_number"].cast("string")), F.concat(F.lit(no), new["lot_number"].cast("string")),
        ),
        _text("city", blank(old["city"]) != blank(new["city"]), old["city"], new["city"]),
        _text(
            "sale_date", F.coalesce(old["sale_date"], F.lit("")) != F.coalesce(new["sale_date"], F.lit("")),
            P.fmt_date(old["sale_date"]), P.fmt_date(new["sale_date"]),
        ),
        _text(
            "observations", blank(old["observations"]) != blank(new["observations"]),
            P.truncate(old["observations"]), P.truncate(new["observations"]),
        ),
        _update(
            "photos", ~photos.isin(0, -1), photo_text(old["photos"]), photo_text(new["photos"]),
            P.direction(photos), P.signed(photos),
        ),
    ]
    return F.array_compact(F.array(*items))


def change_kind(updates: Column, has_previous: Column, created: Column) -> Column:
    """new, price_up, price_down, status_change, updated, or NULL without change."""

    def way(field: str) -> Column:
        return F.get(F.filter(updates, lambda u: u["field"] == field), F.lit(0))["direction"]

    price = way("starting_price")
    return (
        F.when(~has_previous, F.when(created, F.lit("new")))
        .when(price == "up", F.lit("price_up"))
        .when(price == "down", F.lit("price_down"))
        .when(way("status").isNotNull(), F.lit("status_change"))
        .when(F.size(updates) > 0, F.lit("updated"))
    )


def change_detail(updates: Column, kind: Column) -> Column:
    """One-line summary of the most salient change."""

    def only(field: str) -> Column:
        return F.get(F.filter(updates, lambda u: u["field"] == field), F.lit(0))

    price, status = only("starting_price"), only("status")
    n = F.size(updates)
    priced = F.concat(
        F.lit("Mise a prix: "), price["before"], F.lit(" → "), price["after"],
        F.coalesce(F.concat(F.lit(" ("), price["delta"], F.lit(")")), F.lit("")),
    )
    stated = F.concat(F.lit("Statut: "), status["before"], F.lit(" → "), status["after"])
    preview = F.array_join(F.transform(F.slice(updates, 1, 2), lambda u: u["label"]), ", ")
    other = F.concat(
        n.cast("string"), F.when(n > 1, F.lit(" modifications: ")).otherwise(F.lit(" modification: ")), preview,
        F.when(n > 2, F.concat(F.lit(", +"), (n - 2).cast("string"))).otherwise(F.lit("")),
    )
    return (
        F.when(kind == "new", F.lit(NEW_DETAIL))
        .when(kind.isin("price_up", "price_down"), priced)
        .when(kind == "status_change", stated)
        .when(kind == "updated", other)
    )


def search_changes(
    changes: DataFrame, kind: str = "all", query: str = "", page: int = 1, size: int = PAGE_SIZE,
    order: list[Column] | None = None,
) -> DataFrame:
    """One page of the change log, filtered by kind and folded text.

    The page number is clamped to the last page. ``total`` is the number of
    matches. The log is read twice, so hand in a written one.
    """
    hits = changes.filter(F.col("kind").isNotNull()) if kind == "all" else changes.filter(F.col("kind") == kind)
    if query:
        text = fold(F.concat_ws(" ", "label", "detail", "url"))
        hits = hits.filter(F.contains(text, fold(F.lit(query))))
    total = hits.count()
    last_page = max(1, -(-total // size))
    start = (min(page, last_page) - 1) * size
    return hits.orderBy(*(order or [F.col("id")])).offset(start).limit(size).withColumn("total", F.lit(total).cast("bigint"))


def run_counters(changes: DataFrame) -> DataFrame:
    """Counters of one import run over (kind, error) rows."""
    kind = F.col("kind")

    def n(cond: Column) -> Column:
        return F.count_if(F.coalesce(cond, F.lit(False)))

    return changes.agg(
        F.count("*").alias("processed"),
        n(F.col("error").isNull()).alias("saved"),
        n(F.col("error").isNotNull()).alias("failed"),
        n(kind == "new").alias("new_vehicles"),
        n(kind.isin("price_up", "price_down", "status_change", "updated")).alias("updated"),
        n(kind.isNull() & F.col("error").isNull()).alias("unchanged"),
        n(kind == "price_up").alias("price_ups"),
        n(kind == "price_down").alias("price_downs"),
        n(F.col("status_changed")).alias("status_changes"),
    )


def last_errors(changes: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most recent errors of a run."""
    return changes.filter(F.col("error").isNotNull()).orderBy(F.col("id").desc()).limit(k)


def _delta_and_gone(delta: DataFrame, gone: DataFrame) -> DataFrame:
    """Delta rows and disappeared rows under one set of columns."""
    moved = F.col("price_changed")
    items = delta.select("is_new", moved, F.lit(None).cast("string").alias("gone_hash"), F.lit(False).alias("gone"))
    lost = gone.select(
        F.lit(False).alias("is_new"), F.lit(None).cast("bigint").alias("price_changed"),
        F.col("hash_id").alias("gone_hash"), F.lit(True).alias("gone"),
    )
    return items.unionByName(lost)


def batch_summary(delta: DataFrame, gone: DataFrame) -> DataFrame:
    """Totals of a list batch: saved, new, price moves, disappeared."""
    moved = F.col("price_changed")
    return _delta_and_gone(delta, gone).agg(
        F.count_if(~F.col("gone")).alias("saved"),
        F.count_if("is_new").alias("new_vehicles"),
        F.count_if(moved.isNotNull()).alias("price_changes"),
        F.count_distinct("gone_hash").alias("disappeared"),
    )


def alerts(delta: DataFrame, gone: DataFrame) -> DataFrame:
    """Alert counts: new, drops, rises, disappeared with the first three named."""
    moved = F.col("price_changed")
    named = gone.orderBy("vehicle_id").limit(3).select(
        F.lit(False).alias("is_new"), F.lit(None).cast("bigint").alias("price_changed"),
        F.lit(None).cast("string").alias("gone_hash"), F.lit(False).alias("gone"),
        F.struct("vehicle_id", F.concat_ws(" ", "brand", "model").alias("name")).alias("first"),
    )
    rows = _delta_and_gone(delta, gone).unionByName(named, allowMissingColumns=True)
    names = F.transform(F.sort_array(F.collect_list("first")), lambda x: x["name"])
    return rows.agg(
        F.count_if("is_new").alias("new"),
        F.count_if(moved < 0).alias("drops"),
        F.count_if(moved > 0).alias("rises"),
        F.count_if("gone").alias("disappeared"),
        F.array_join(names, ", ").alias("first_three"),
    )

"""Similarity between listed items, and the best offers per item.

Items that agree on every scored attribute form one signature. Scores are
computed between signatures, never between copies, and candidates are cut to
what the result can use before any pair is formed, so a large group of copies
costs as much as one row. Scores of different signatures of comparable models
are computed by blocks, see :mod:`hammertrail.operators.blocks`.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammertrail.functions import prices as P
from hammertrail.functions.text import blank_to_null, ci_contains, ci_equal, first_word, trim_level
from hammertrail.operators.blocks import LEVELS, best_offers, block_pairs, level_counts, scored_keys
from hammertrail.operators.containment import FEW_TEXTS, holding
from hammertrail.operators.ordering import top_n
from hammertrail.session import cut_lineage

ATTRIBUTES = [
    "brand", "model", "version", "year", "mileage", "color", "fuel", "transmission",
    "engine_size", "power",
]

# --- fixed values -----------------------------------------------------------
BRAND_POINTS, MODEL_POINTS, CLOSE_MODEL_POINTS = 15, 25, 15
VERSION_POINTS, FUEL_POINTS, GEARBOX_POINTS, COLOUR_POINTS = 10, 8, 7, 5
ENGINE_POINTS, POWER_POINTS = 3, 2
YEAR_BANDS = [(0, 15, "Même année"), (1, 10, "Année proche (±1)"), (2, 5, "Année proche (±2)")]
KM_BANDS = [
    (5000, 10, "Kilométrage très proche"), (15000, 7, "Kilométrage proche"),
    (30000, 3, "Kilométrage comparable"),
]
OFFER_STATUSES = ["available", "auction_live", "unsold"]
SAME_KM = 500
YEAR_TOLERANCE, MILEAGE_TOLERANCE = 2, 50_000
# ----------------------------------------------------------------------------


def _band(diff: Column, bands: list[tuple]) -> tuple[Column, Column]:
    points, reason = F.lit(0), F.lit(None).cast("string")
    for limit, value, text in reversed(bands):
        points = F.when(diff <= limit, F.lit(value)).otherwise(points)
        reason = F.when(diff <= limit, F.lit(text)).otherwise(reason)
    return points, reason


def _both(a: Column, b: Column) -> Column:
    """Equal and neither missing nor 0."""
    return F.coalesce((P.known(a) == P.known(b)), F.lit(False))


def similarity_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """0 to 100; below the lowest level when brand or model differ."""
    year, _ = _band(F.abs(a["year"] - b["year"]), YEAR_BANDS)
    km, _ = _band(F.abs(a["mileage"] - b["mileage"]), KM_BANDS)

    def given(cond: Column, value: int) -> Column:
        return F.when(cond, F.lit(value)).otherwise(F.lit(0))

    same_model = ci_equal(a["model"], b["model"])
    close_model = ci_contains(a["model"], b["model"])
    total = (
        F.when(same_model, F.lit(MODEL_POINTS)).otherwise(F.lit(CLOSE_MODEL_POINTS))
        + given((a["version"] != "") & ci_equal(a["version"], b["version"]), VERSION_POINTS)
        + year + km
        + given(ci_equal(a["fuel"], b["fuel"]), FUEL_POINTS)
        + given(ci_equal(a["transmission"], b["transmission"]), GEARBOX_POINTS)
        + given(ci_equal(a["color"], b["color"]), COLOUR_POINTS)
        + given(_both(a["engine_size"], b["engine_size"]), ENGINE_POINTS)
        + given(_both(a["power"], b["power"]), POWER_POINTS)
        + F.lit(BRAND_POINTS)
    )
    return (
        F.when(~ci_equal(a["brand"], b["brand"]), F.lit(0))
        .when(~close_model, F.lit(BRAND_POINTS))
        .when(P.power_gate(a["power"], b["power"]), F.lit(0))
        .otherwise(F.least(total, F.lit(100)))
    )


def similarity_reasons(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Readable reasons behind :func:`similarity_score`."""
    _, year = _band(F.abs(a["year"] - b["year"]), YEAR_BANDS)
    _, km = _band(F.abs(a["mileage"] - b["mileage"]), KM_BANDS)

    def said(cond: Column, text: str) -> Column:
        return F.when(cond, F.lit(text))

    powers = (P.known(a["power"]).isNotNull()) & (P.known(b["power"]).isNotNull())
    gap = b["power"] - a["power"]
    power = F.when(
        powers & (gap == 0), F.concat(F.lit("Même puissance ("), a["power"].cast("string"), F.lit(" ch)"))
    ).when(
        powers,
        F.concat(
            F.lit("Puissance "), F.when(gap > 0, F.lit("+")).otherwise(F.lit("-")),
            F.abs(gap).cast("string"), F.lit(" ch ("), b["power"].cast("string"), F.lit(" ch)"),
        ),
    )
    same_model = ci_equal(a["model"], b["model"])
    model = F.when(same_model, F.lit("Même modèle")).otherwise(F.lit("Modèle similaire"))
    brand = F.lit("Même marque")
    full = F.array_compact(
        F.array(
            brand, model, said((a["version"] != "") & ci_equal(a["version"], b["version"]), "Même finition"),
            year, km, said(ci_equal(a["fuel"], b["fuel"]), "Même carburant"),
            said(ci_equal(a["transmission"], b["transmission"]), "Même boîte"),
            said(ci_equal(a["color"], b["color"]), "Même couleur"),
            said(_both(a["engine_size"], b["engine_size"]), "Même cylindrée"), power,
        )
    )
    gated = F.concat(
        F.lit("Puissance trop différente ("), a["power"].cast("string"), F.lit(" ch vs "),
        b["power"].cast("string"), F.lit(" ch)"),
    )
    return (
        F.when(~ci_equal(a["brand"], b["brand"]), F.array(F.lit("Marque différente")))
        .when(~ci_contains(a["model"], b["model"]), F.array(brand, F.lit("Modèle différent")))
        .when(P.power_gate(a["power"], b["power"]), F.array(brand, model, gated))
        .otherwise(full)
    )


def side(prefix: str, names: list[str] = ATTRIBUTES) -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in names}


def signature(df: DataFrame, cols: list[str] = ATTRIBUTES) -> DataFrame:
    """Add ``sig``, a key that is equal exactly for equal attributes."""
    return df.withColumn("sig", F.md5(F.to_json(F.struct(*cols))))


def model_pairs(items: DataFrame) -> DataFrame:
    """Model names of one brand of which one contains the other.

    Works on the vocabulary of names, not on items.
    """
    names = items.select(F.lower("brand").alias("_brand"), F.lower("model").alias("_short")).distinct()
    held = holding(names, names.withColumnRenamed("_short", "_long"), ["_brand"], "_short", "_long")
    # Either side may be the longer name.
    turned = held.filter(F.col("_short") != F.col("_long"))
    return held.select("_brand", F.col("_short").alias("_qmodel"), F.col("_long").alias("_cmodel")).unionByName(
        turned.select("_brand", F.col("_long").alias("_qmodel"), F.col("_short").alias("_cmodel"))
    )


def match_summary(items: DataFrame) -> DataFrame:
    """Per item: how many others match at each level, and the best score."""
    signed = signature(items)
    sigs = cut_lineage(signed.groupBy("sig", *ATTRIBUTES).agg(F.count("*").alias("n")))
    pairs = cut_lineage(model_pairs(sigs))
    keyed = scored_keys(sigs).drop(*ATTRIBUTES)
    counted = block_pairs(keyed.drop("n"), keyed, pairs, "sig", level_counts, LEVELS)
    levels = ["n_exact", "n_same_model", "n_similar"]
    per_sig = counted.groupBy("sig").agg(*[F.sum(c).alias(c) for c in levels], F.max("best_score").alias("best_score"))
    return signed.select("id", "sig").join(per_sig, "sig", "left").select(
        "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in levels], "best_score"
    )


def same_vehicle(q: dict[str, Column], c: dict[str, Column]) -> Column:
    """Two listings of one physical vehicle."""

    def equal(name: str) -> Column:
        return F.coalesce(blank_to_null(q[name]) == blank_to_null(c[name]), F.lit(False))

    close = (
        (F.upper(q["brand"]) == F.upper(c["brand"])) & (F.upper(q["model"]) == F.upper(c["model"]))
        & (q["year"] == c["year"])
        & (F.abs(F.coalesce(q["mileage"], F.lit(0)) - F.coalesce(c["mileage"], F.lit(0))) <= SAME_KM)
    )
    return equal("hash_id") | equal("reference") | equal("source_url") | close


def spec_delta(cand: dict[str, Column], cur: dict[str, Column]) -> Column:
    """Readable differences in the order of their effect on the price."""

    def words(a: Column, b: Column, lead: str = "", unit: str = "") -> Column:
        text = F.concat(F.lit(lead), a.cast("string"), F.lit(unit + " vs "), b.cast("string"), F.lit(unit))
        differs = (F.coalesce(a.cast("string"), F.lit("")) != "") & (F.coalesce(b.cast("string"), F.lit("")) != "")
        return F.when(differs & (F.lower(a.cast("string")) != F.lower(b.cast("string"))), text)

    years = cand["year"] - cur["year"]
    year = F.when(
        years != 0,
        F.concat(
            F.when(years > 0, F.lit("+")).otherwise(F.lit("")), years.cast("string"), F.lit(" an"),
            F.when(F.abs(years) > 1, F.lit("s")).otherwise(F.lit("")),
        ),
    )
    gap = P.known(cand["power"]) - P.known(cur["power"])
    power = F.when(
        gap != 0, F.concat(F.when(gap > 0, F.lit("+")).otherwise(F.lit("")), gap.cast("string"), F.lit(" ch"))
    )
    engine = F.when(
        cand["power"].eqNullSafe(cur["power"]),
        words(P.known(cand["engine_size"]), P.known(cur["engine_size"]), unit=" cc"),
    )
    return F.array_compact(
        F.array(
            year, power, words(trim_level(cand["version"]), trim_level(cur["version"])),
            words(cand["fuel"], cur["fuel"]), words(cand["transmission"], cur["transmission"], "Boîte "),
            engine, words(cand["color"], cur["color"]),
        )
    )


def _spare_offers(offers: DataFrame, group: list[str], k: int) -> DataFrame:
    """The rows of each ``group`` that can be among the first ``k`` by id for some query.

    A query leaves out itself and the rows of one hash, one reference and one
    address. With ``m = k + 1``, a row that follows m rows of its own triple of
    these is never needed. Of those left, one address holds at most m rows of a
    (hash, reference), so 2m rows of a pair suffice; likewise 5m of a single
    value, and 16m of a group. Groups up to that size stay whole.
    """
    m, marks = k + 1, ["_hash", "_ref", "_url"]
    signed = signature(offers, group).withColumns(
        {"_hash": blank_to_null(F.col("hash_id")), "_ref": blank_to_null(F.col("reference")), "_url": blank_to_null(F.col("source_url"))}
    )
    signed = cut_lineage(signed)  # the cuts below would be planned for minutes otherwise
    large = signed.groupBy("sig").agg(F.count("*").alias("_n")).filter(F.col("_n") > 16 * m).select("sig")
    few = signed.join(large, "sig", "left_semi")
    for width, limit in ((3, m), (2, 2 * m), (1, 5 * m), (0, 16 * m)):
        for held in combinations(marks, width):
            few = top_n(few, ["sig", *held], [F.col("id")], limit, "_rn").drop("_rn")
    return cut_lineage(signed.join(large, "sig", "left_anti").unionByName(few))


def offers_elsewhere(items: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` best comparable offers outside an item's own auction.

    Order: level, availability, price difference (unknown last), score, id.

    Candidates that agree on attributes, status, price and auction are
    interchangeable except for an item's own listings, which are recognised by
    hash, address or reference; see :func:`_spare_offers`.
    """
    group = [*ATTRIBUTES, "status", "starting_price", "auction_id"]
    open_now = items.filter(F.col("status").isin(OFFER_STATUSES))
    few = _spare_offers(open_now.withColumn("_listed", F.col("hash_id").isNotNull()), [*group, "_listed"], k)
    keep = [*group, "id", "hash_id", "reference", "source_url"]
    availability = F.when(F.col("status") == "available", 2).when(F.col("status") == "auction_live", 1).otherwise(0)
    more = {"_ubrand": F.upper("brand"), "_umodel": F.upper("model"), "_availability": availability}
    # A row without id is neither a query nor an offer.
    asked, offered = (scored_keys(rows.select(*keep).filter("id is not null")).withColumns(more) for rows in (items, few))
    types = dict(items.dtypes)
    schema = ", ".join([f"{side_}_{c} {types[c]}" for side_ in "qc" for c in keep] + ["score int"])
    ranked = block_pairs(asked, offered, cut_lineage(model_pairs(items)), "id", best_offers(k, keep, SAME_KM), schema)
    price = P.known(F.col("q_starting_price"))
    ranked = ranked.withColumn("level", P.match_level(F.col("score"))).withColumn("price_diff", F.col("c_starting_price") - price)
    availability = F.when(F.col("c_status") == "available", 2).when(F.col("c_status") == "auction_live", 1).otherwise(0)
    order = [
        F.when(F.col("level") == "same_model", 2).otherwise(1).desc(), availability.desc(),
        F.col("price_diff").asc_nulls_last(), F.col("score").desc(), F.col("c_id"),
    ]
    best = top_n(ranked, ["q_id"], order, k, "rank")
    return best.select(
        F.col("q_id").alias("id"), "rank", F.col("c_id").alias("offer_id"), "score", "level", "price_diff",
        (F.col("c_mileage") - F.col("q_mileage")).alias("km_diff"),
        P.score_tone(F.col("score")).alias("tone"),
        spec_delta(side("c_"), side("q_")).alias("deltas"),
        similarity_reasons(side("q_"), side("c_")).alias("reasons"),
    )


def offers_summary(offers: DataFrame) -> DataFrame:
    return offers.groupBy("id").agg(
        F.count("*").alias("n_offers"),
        F.count_if(F.col("level") == "same_model").alias("n_same_model"),
        F.count_if(F.coalesce(F.col("price_diff") < 0, F.lit(False))).alias("n_cheaper"),
    )


def _listed(rows: DataFrame, keys: list[str], order: str, cols: list[str], name: str) -> DataFrame:
    """Collect an already limited number of rows per key, sorted by rank."""
    item = F.struct(F.col(order).alias("_order"), *cols)
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias(name))


def same_model(items: DataFrame, k: int = 50) -> DataFrame:
    """Up to ``k`` entities of the brand whose model contains the item's model.

    Candidates are found once per (brand, model) and cut to ``k + 1`` by id;
    the item itself is then left out. Entities without a snapshot count
    towards ``k`` but are not listed.
    """
    rows = items.withColumns({"_brand": F.upper("brand"), "_model": F.upper("model")})
    names = rows.select("_brand", "_model").distinct()
    holds = holding(names.withColumnRenamed("_model", "_key"), names, ["_brand"], "_key", "_model")
    stored = items.withColumns({"_brand": F.col("brand"), "_model": F.upper("model")})
    first = top_n(stored, ["_brand", "_model"], [F.col("id")], k + 1, "_rn")
    per_key = top_n(first.join(holds, ["_brand", "_model"]), ["_brand", "_key"], [F.col("id")], k + 1, "_rn")
    lists = _listed(per_key, ["_brand", "_key"], "_rn", ["id", "year", "mileage", "starting_price"], "_all")
    me = rows.select("id", "_brand", F.col("_model").alias("_key"), "year", "mileage", "starting_price")
    others = F.slice(F.filter("_all", lambda x: x["id"] != F.col("id")), 1, k)
    return me.join(lists, ["_brand", "_key"]).withColumn(
        "others", F.filter(others, lambda x: x["mileage"].isNotNull())
    ).drop("_all", "_brand", "_key")


def array_mean(values: Column) -> Column:
    """Mean of the positive entries, NULL without any."""
    valid = F.filter(values, lambda v: v > 0)
    total = F.aggregate(valid, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return F.when(F.size(valid) > 0, total / F.size(valid))


def same_model_averages(listed: DataFrame) -> DataFrame:
    """Average year, mileage and price of the listed entities, and the verdicts."""

    def verdict(own: Column, mean: Column, higher_better: bool) -> Column:
        better = own > mean if higher_better else own < mean
        return (
            F.when(mean.isNull(), F.lit(None).cast("string")).when(own == mean, F.lit("neutral"))
            .when(better, F.lit("better")).otherwise(F.lit("worse"))
        )

    out = listed.withColumn("n_others", F.size("others").cast("bigint"))
    for name, higher in [("year", True), ("mileage", False), ("starting_price", False)]:
        mean = array_mean(F.col("others").getField(name))
        own = F.coalesce(F.col(name), F.lit(0))
        out = out.withColumn(f"avg_{name}", P.half_up(mean)).withColumn(
            f"{name}_verdict", verdict(own, mean, higher)
        )
    return out.drop("others")


def sold_candidates(sold: DataFrame, keys: DataFrame, n: int = 50) -> DataFrame:
    """For each (brand, word): the newest sold rows of models holding the word.

    A query looks at the ``n`` newest rows that are not its own listing. Own
    rows and rows without hash are at most ``n`` each after limiting every
    hash to ``n``, so ``3 * n`` rows per key hold every possible answer.
    """
    rows = sold.filter((F.col("status") == "sold") & F.col("sold_price").isNotNull()).withColumn(
        "_model", F.upper("model")
    )
    newest = [F.col("scraped_at").desc(), F.col("id").desc()]
    own = top_n(rows, ["brand", "_model", "hash_id"], newest, n, "_rn")
    some = top_n(own, ["brand", "_model"], newest, 3 * n, "_rn")
    names = rows.select("brand", "_model").distinct()
    holds = holding(keys.select(F.col("_brand").alias("brand"), "_word"), names, ["brand"], "_word", "_model")
    joined = some.join(holds, ["brand", "_model"])
    limited = top_n(joined, ["brand", "_word", "hash_id"], newest, n, "_rn")
    last = top_n(limited, ["brand", "_word"], newest, 3 * n, "_rn")
    # What a row is worth to a query but for the query's own listing, year and mileage depends on the key alone.
    fallback = F.concat_ws("-", "brand", "model", F.col("year").cast("string"))
    before = Window.partitionBy("brand", "_word", "_listing").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_listing", F.coalesce(blank_to_null(F.col("hash_id")), fallback)).withColumns(
        {
            "repeats": F.count(F.lit(1)).over(before) > 0,
            "least": F.min("hash_id").over(before), "most": F.max("hash_id").over(before),
            "drives": ~P.not_drivable("comparable", F.col("observations"), F.col("model")),
            "named": F.coalesce(F.contains(F.upper("model"), F.col("_word")), F.lit(False)),
        }
    )
    cols = ["hash_id", "year", "mileage", "sold_price", "id", "repeats", "least", "most", "drives", "named"]
    lists = _listed(last.withColumnRenamed("brand", "_brand"), ["_brand", "_word"], "_rn", cols, "_sold")
    return lists.withColumns({"_hashes": F.array_compact(F.col("_sold.hash_id")), "_usual": _seen_by_others(n)})


def _seen_by_others(n: int) -> Column:
    """:func:`_seen_by` for any listing that is not among the rows."""
    foreign = F.filter("_sold", lambda x: x["hash_id"].isNotNull())
    return F.filter(F.slice(foreign, 1, n), lambda x: x["least"].isNull())


def _seen_by(mine: Column, n: int) -> Column:
    """The ``n`` newest rows of ``_sold`` that are not the listing ``mine``, the first of every listing.

    A row is left out when one of its listing stands before it and is not ``mine`` itself; ``least`` and ``most`` are
    the smallest and the largest hash of those before it.
    """
    foreign = F.filter("_sold", lambda x: mine.isNull() | (x["hash_id"] != mine))

    def shown(x: Column) -> Column:
        other = F.coalesce((x["least"] != mine) | (x["most"] != mine), F.lit(False))
        return ~F.when(mine.isNull(), x["repeats"]).otherwise(other)

    return F.filter(F.slice(foreign, 1, n), shown)


def similar_sold(queries: DataFrame, sold: DataFrame, n: int = 50, k: int = 20) -> DataFrame:
    """Sold comparables and price statistics per query profile.

    ``queries``: brand, model, year, mileage, exclude_hash. The newest ``n``
    sold rows are de-duplicated per listing; statistics use every truly
    comparable one, ``results`` the ``k`` best by model, year and mileage.
    """
    profile = ["brand", "model", "year", "mileage", "exclude_hash"]
    profiles = queries.select(*profile).distinct().withColumns(
        {"_brand": F.upper("brand"), "_word": first_word(F.col("model"))}
    )
    lists = sold_candidates(sold, profiles.select("_brand", "_word").distinct(), n)
    mine = F.col("exclude_hash")
    # Nearly all queries are of listings that are not on the list, and see the same rows.
    elsewhere = mine.isNotNull() & ~F.array_contains("_hashes", mine)
    rows = profiles.join(lists, ["_brand", "_word"], "left").withColumn(
        "_seen", F.when(elsewhere, F.col("_usual")).otherwise(_seen_by(mine, n))
    )

    def flags(x: Column) -> Column:
        year = F.coalesce(F.abs(x["year"] - F.col("year")) <= YEAR_TOLERANCE, F.lit(False))
        km = F.coalesce(F.abs(x["mileage"] - F.col("mileage")) <= MILEAGE_TOLERANCE, F.lit(False))
        fits = x["drives"] & x["named"] & (F.col("year").isNull() | year) & (F.col("mileage").isNull() | km)
        weight = x["named"].cast("int") * 4 + year.cast("int") * 2 + km.cast("int")
        return F.struct(
            (-weight).alias("w"), x["_order"].alias("o"), x["id"].alias("id"), x["hash_id"].alias("hash_id"),
            x["sold_price"].alias("sold_price"), fits.alias("fits"),
        )

    rows = rows.withColumn("_flagged", F.transform("_seen", flags))
    sample = F.transform(F.filter("_flagged", lambda x: x["fits"]), lambda x: x["sold_price"])
    rows = rows.withColumn("_prices", F.coalesce(sample, F.array().cast("array<bigint>")))
    total = F.aggregate("_prices", F.lit(0).cast("bigint"), lambda a, v: a + v)
    size = F.size("_prices")
    return rows.select(
        *profile,
        size.cast("bigint").alias("n_comparable"),
        F.when(size > 0, P.half_up(total / size)).alias("avg_sold"),
        F.array_min("_prices").alias("min_sold"),
        F.array_max("_prices").alias("max_sold"),
        F.slice(F.sort_array("_flagged"), 1, k).alias("results"),
    )


PEER = ["id", "hash_id", "starting_price", "sold_price", "status", "matches"]


def peers_in_auction(lots: DataFrame, k: int = 10) -> DataFrame:
    """Up to ``k`` lots of the same brand in the same auction, per lot.

    Lots whose model holds the first word of the own model come first, then
    the cheaper one. The lots of one auction and brand are brought together
    by one shuffle and compared there; only where they are more than
    ``FEW_TEXTS`` are candidates ranked, see :func:`_peers_of_many`.
    """
    rows = lots.withColumns(
        {"_brand": F.upper("brand"), "_model": F.upper("model"), "_word": first_word(F.col("model")),
         "_price": F.coalesce("starting_price", F.lit(0))}
    ).select("id", "auction_id", "hash_id", "starting_price", "sold_price", "status", "_brand", "_model", "_word", "_price")
    key = ["auction_id", "_brand"]
    # A lot without auction or brand has no peers and is none.
    rows = rows.dropna(subset=key)
    many = rows.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > FEW_TEXTS).select(*key)
    many = cut_lineage(many)
    if many.isEmpty():
        return _peers_of_few(rows, key, k)
    few = _peers_of_few(rows.join(many, key, "left_anti"), key, k)
    return few.unionByName(_peers_of_many(rows.join(many, key, "left_semi"), key, k))


def _peers_of_few(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """The peers within small groups, each held as one array."""
    lot = F.struct("_price", "id", "hash_id", "starting_price", "sold_price", "status", "_model", "_word")
    groups = rows.repartition(*key).groupBy(*key).agg(F.sort_array(F.collect_list(lot)).alias("_all"))
    mine = groups.select("auction_id", "_all", F.explode("_all").alias("_me")).filter("_me._word IS NOT NULL")
    foreign = F.filter("_all", lambda x: ~x["hash_id"].eqNullSafe(F.col("_me.hash_id")))

    def peer(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in PEER[:-1]], F.contains(x["_model"], F.col("_me._word")).alias("matches"))

    peers = F.transform(foreign, peer)
    # The array is sorted by price and id; a lot whose model is unknown comes last.
    best = F.concat(*[F.filter("_peers", hit) for hit in (lambda x: x["matches"], lambda x: ~x["matches"], lambda x: x["matches"].isNull())])
    return mine.withColumn("_peers", peers).select(
        F.col("_me.id").alias("id"), "auction_id", F.col("_me.starting_price").alias("starting_price"), F.slice(best, 1, k).alias("peers")
    )


def _peers_of_many(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """The peers within large groups.

    Candidates are ranked once per (auction, brand, word); the own listing is
    left out afterwards, which is why every hash is limited to ``k`` and the
    list to twice that. Fewer than ``2 * k`` lots can match where others are
    needed at all, so the ``4 * k`` cheapest of the auction and brand hold every
    other lot that can appear. Fitting lots come from the index of names.
    """
    cheap = [F.col("_price"), F.col("id")]
    own = top_n(rows, [*key, "_model", "hash_id"], cheap, k, "_rn")
    large = cut_lineage(top_n(own, [*key, "_model"], cheap, 2 * k, "_rn").drop("_word", "_rn"))
    words = rows.select(*key, "_word").distinct()
    match = F.contains("_model", "_word")
    fitting = large.join(holding(words, large, key, "_word", "_model"), [*key, "_model"]).withColumn("_match", F.lit(True))
    cheapest = top_n(top_n(large, [*key, "hash_id"], cheap, k, "_rn"), key, cheap, 4 * k, "_rn").drop("_rn")
    others = cheapest.join(words, key).withColumn("_match", match).filter(~F.coalesce("_match", F.lit(False)))
    order = [F.col("_match").desc(), *cheap]
    limited = top_n(fitting.unionByName(others), [*key, "_word", "hash_id"], order, k, "_rn")
    best = top_n(limited, [*key, "_word"], order, 2 * k, "_rn")
    lists = _listed(best, [*key, "_word"], "_rn", [*PEER[:-1], F.col("_match").alias("matches")], "_all")
    peers = F.slice(F.filter("_all", lambda x: ~x["hash_id"].eqNullSafe(F.col("hash_id"))), 1, k)
    plain = F.transform(peers, lambda x: F.struct(*[x[c].alias(c) for c in PEER]))
    return rows.join(lists, [*key, "_word"]).select("id", "auction_id", "starting_price", plain.alias("peers"))


def peer_stats(listed: DataFrame) -> DataFrame:
    """Price range of the peers and how the own starting price compares."""
    starts = F.filter(F.transform("peers", lambda x: x["starting_price"]), lambda v: v > 0)
    sold = F.transform(
        F.filter("peers", lambda x: (x["status"] == "sold") & (x["sold_price"] > 0)), lambda x: x["sold_price"]
    )
    rows = listed.withColumn("_starts", starts).withColumn("avg_sold", P.half_up(array_mean(sold)))
    avg = P.half_up(array_mean(F.col("_starts")))
    own = P.known(F.col("starting_price"))
    target = F.coalesce("avg_sold", "avg_start")
    return rows.withColumn("avg_start", avg).select(
        "id", F.size("peers").cast("bigint").alias("n_peers"), "avg_start",
        F.array_min("_starts").alias("min_start"), F.array_max("_starts").alias("max_start"), "avg_sold",
        F.when(target.isNotNull() & own.isNotNull(), F.when(own <= target, F.lit("good")).otherwise(F.lit("high"))).alias("verdict"),
        (own - F.col("avg_start")).alias("vs_mean"),
    )

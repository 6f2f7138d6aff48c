"""Entity resolution: blocked scoring, resolution cascade and clustering.

A stored entity has its own attributes and those of its latest snapshot
(prefix ``l_``). An incoming record has one set. Candidate pairs come from
equi joins that together cover every pair the score can accept.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammertrail.functions import prices as P
from hammertrail.functions.text import blank_to_null, normalize_key, overlap, tokens
from hammertrail.operators import nearest
from hammertrail.operators.blocks import block_pairs
from hammertrail.session import cut_lineage, shuffled

# --- fixed values -----------------------------------------------------------
MODEL_FULL, MODEL_CLOSE, MODEL_MIN = 28, 18, 0.6
YEAR_POINTS = {0: 14, 1: 8}
VERSION_BANDS = [(0.75, 12, "close_version"), (0.5, 6, "partial_version")]
KM_BANDS = [
    (500, 22, "km_very_close"), (1500, 18, "km_close"), (3000, 14, "km_plus_minus_3k"),
    (5000, 8, "km_plus_minus_5k"),
]
FUEL, GEARBOX, COLOUR, ENGINE, POWER, FISCAL = 8, 8, 5, 8, 6, 4
CHECK, CONDITION, PHOTO = 35, 20, 15
KM_GAP, KM_PROOF = 5000, 500
STRONG, STRONG_CLOSE, STRONG_CLOSE_KM = 70, 55, 3000
HASH_SCORE = 50
# ----------------------------------------------------------------------------

# Attributes that decide a score, in the same form for incoming and stored.
SCORED = [
    "brand_block", "brand_key", "model_tokens", "version_tokens", "year", "km", "fuel", "gearbox", "colour",
    "engine", "power", "fiscal", "check", "condition", "photo",
]


def _record(df: DataFrame, block: Column, given: dict[str, Column]) -> DataFrame:
    """Bring one side into the form of ``SCORED``; keeps id and reference.

    Texts become normalised keys, and '' and 0 become NULL, so that two
    attributes agree exactly when they are equal.
    """

    def text(name: str) -> Column:
        return blank_to_null(normalize_key(given[name]))

    cols = {
        "brand_block": block,
        "brand_key": normalize_key(F.col("brand")),
        "model_tokens": tokens(F.col("model")),
        "version_tokens": tokens(F.col("version")),
        "year": F.col("year"),
        "km": given["mileage"],
        "fuel": text("fuel"),
        "gearbox": text("transmission"),
        "colour": text("color"),
        "engine": P.known(given["engine_size"]),
        "power": P.known(given["power"]),
        "fiscal": P.known(given["fiscal_power"]),
        "check": blank_to_null(given["technical_check_url"]),
        "condition": blank_to_null(given["condition_image_url"]),
        "photo": blank_to_null(given["photo_hash"]),
    }
    reference = blank_to_null(F.col("reference")).alias("reference")
    return df.select("id", reference, *[v.alias(k) for k, v in cols.items()])


TEXTS = ["color", "fuel", "transmission"]
NUMBERS = ["engine_size", "power", "fiscal_power"]
MARKS = ["technical_check_url", "condition_image_url", "photo_hash"]


def incoming(records: DataFrame, block: Column) -> DataFrame:
    """Incoming records in scored form."""
    return _record(records, block, {c: F.col(c) for c in ["mileage", *TEXTS, *NUMBERS, *MARKS]})


def stored(entities: DataFrame, block: Column) -> DataFrame:
    """Stored entities in scored form: own facts first, then the snapshot's."""
    given = {c: F.col("l_" + c) for c in ["mileage", *MARKS]}
    given |= {c: F.coalesce(blank_to_null(F.col(c)), blank_to_null(F.col("l_" + c))) for c in TEXTS}
    given |= {c: F.coalesce(c, "l_" + c) for c in NUMBERS}
    return _record(entities, block, given)


def stored_as_incoming(entities: DataFrame, block: Column) -> DataFrame:
    """Stored entities read as incoming records: the snapshot's facts first."""
    given = {c: F.col("l_" + c) for c in MARKS}
    given["mileage"] = F.coalesce("l_mileage", F.lit(0))
    given |= {c: F.coalesce("l_" + c, c) for c in [*TEXTS, *NUMBERS]}
    return _record(entities, block, given)


def _agree(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def identity_score(i: dict[str, Column], c: dict[str, Column]) -> dict[str, Column]:
    """Score, reasons and km difference of incoming ``i`` against stored ``c``.

    Both map ``SCORED`` and reference to columns. An entity without a snapshot
    has ``km`` NULL. ``i`` may hold ``model_overlap``, where that is known.
    """
    km = F.abs(c["km"] - i["km"])
    same = {n: _agree(i[n], c[n]) for n in SCORED[6:]}
    fingerprint = same["check"] | same["condition"] | same["photo"]
    model = i["model_overlap"] if "model_overlap" in i else overlap(c["model_tokens"], i["model_tokens"])
    version = overlap(c["version_tokens"], i["version_tokens"])
    years = F.abs(c["year"] - i["year"])

    signals: list[tuple[Column, int, str]] = [
        (model >= 1, MODEL_FULL, "same_model"),
        ((model >= MODEL_MIN) & (model < 1), MODEL_CLOSE, "close_model"),
        (years == 0, YEAR_POINTS[0], "same_year"),
        (years == 1, YEAR_POINTS[1], "year_plus_minus_1"),
    ]
    below = F.lit(True)
    for limit, value, reason in VERSION_BANDS:
        signals.append((below & (version >= limit), value, reason))
        below = version < limit
    above = -1
    for limit, value, reason in KM_BANDS:
        signals.append((F.coalesce((km > above) & (km <= limit), F.lit(False)), value, reason))
        above = limit
    signals += [
        (same["fuel"], FUEL, "same_fuel"), (same["gearbox"], GEARBOX, "same_transmission"),
        (same["colour"], COLOUR, "same_color"), (same["engine"], ENGINE, "same_engine_size"),
        (same["power"], POWER, "same_power"), (same["fiscal"], FISCAL, "same_fiscal_power"),
        (same["check"], CHECK, "same_technical_check"), (same["condition"], CONDITION, "same_condition_sheet"),
        (same["photo"], PHOTO, "same_photo_hash"),
    ]
    points = F.lit(0)
    for cond, value, _ in signals:
        points = points + F.when(cond, F.lit(value)).otherwise(F.lit(0))
    named = [F.when(cond, F.lit(reason)) for cond, _, reason in signals]

    both_refs = i["reference"].isNotNull() & c["reference"].isNotNull()
    crossed = both_refs & (i["reference"] != c["reference"])
    near = F.coalesce(km <= KM_PROOF, F.lit(False))
    spec = same["power"] | same["gearbox"] | same["engine"]
    stop = (
        F.when(c["brand_key"] != i["brand_key"], F.lit("brand_mismatch"))
        .when(model < MODEL_MIN, F.lit("model_mismatch"))
        .when(years > 1, F.lit("year_mismatch"))
    )
    gate = (
        F.when(F.coalesce(km > KM_GAP, F.lit(False)) & ~fingerprint, F.lit("mileage_gap_without_fingerprint"))
        .when(crossed & ~fingerprint & ~near, F.lit("different_reference_without_proof"))
        .when(~both_refs & ~fingerprint & ~spec, F.lit("no_reference_no_discriminator"))
    )
    closing = F.coalesce(gate, F.when(crossed, F.lit("cross_reference_accepted")))
    return {
        "score": F.when(stop.isNotNull() | gate.isNotNull(), F.lit(0)).otherwise(points),
        "reasons": F.when(stop.isNotNull(), F.array(stop)).otherwise(F.array_compact(F.array(*named, closing))),
        "km_diff": km,
    }


def is_strong(score: Column, km: Column) -> Column:
    return (score >= STRONG) | F.coalesce((score >= STRONG_CLOSE) & (km <= STRONG_CLOSE_KM), F.lit(False))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _leads(model: Column) -> Column:
    """The model tokens of which a match needs one.

    Two sets that share 60 % of the larger one share a token among the first
    ``n - ceil(0.6 n) + 1`` of each, in any fixed order; longer tokens, being
    rarer, come first here.
    """
    ordered = F.transform(
        F.sort_array(F.transform(model, lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))), lambda x: x["t"]
    )
    n = F.size(model)
    # ceil(0.6 n) in whole numbers: floor((3 n + 4) / 5)
    need = F.when(n > 0, n - F.floor((n * 3 + 4) / 5).cast("int") + 1).otherwise(0)
    return F.slice(ordered, F.lit(1), need)


def _matching_models(i: DataFrame, c: DataFrame) -> DataFrame:
    """(_brand, i_model_tokens, c_model_tokens, i_model_overlap) of the models that overlap enough.

    Works on the vocabulary of models, not on rows.
    """

    def models(rows: DataFrame, side: str) -> DataFrame:
        model = F.col(side + "model_tokens")
        distinct = rows.select(F.col(side + "brand_block").alias("_brand"), model).distinct()
        return distinct.withColumn(side + "leads", _leads(model)).withColumn("_token", F.explode(side + "leads"))

    # A pair that shares several leading tokens is taken at the first one.
    once = F.col("_token") == F.array_min(F.array_intersect("i_leads", "c_leads"))
    share = overlap(F.col("c_model_tokens"), F.col("i_model_tokens"))
    pairs = models(i, "i_").join(models(c, "c_"), ["_brand", "_token"]).filter(once & (share >= MODEL_MIN))
    return pairs.select("_brand", "i_model_tokens", "c_model_tokens", share.alias("i_model_overlap"))


def candidate_pairs(inputs: DataFrame, known: DataFrame, same_reference_only: bool = False) -> DataFrame:
    """Every (incoming, stored) pair that the score can accept, once.

    Accepted pairs agree on brand, have models that overlap enough and years
    within one, and fall into exactly one of these cases:

    * a fingerprint (inspection, condition sheet or photo) agrees;
    * the same reference;
    * two different references, mileage within 500 km; or a reference is
      missing, mileage within 5000 km or unknown, and power, gearbox or engine
      agrees.

    Both sides are in scored form and are written once, since every case reads
    them. Columns come back as i_* and c_*. Where both sides have a ``label``,
    pairs of equal labels are left out: the most frequent label of a model and
    year is not joined with itself, so these pairs are not formed either.
    Inputs that are ``crowded`` get no pairs by mileage alone.
    """
    i, c = cut_lineage(_prefixed(inputs, "i_")), cut_lineage(_prefixed(known, "c_"))
    models = cut_lineage(_matching_models(i, c))
    base = ["_brand", "c_model_tokens", "_year"]
    i = i.withColumn("_brand", F.col("i_brand_block")).join(models, ["_brand", "i_model_tokens"])
    i = i.withColumn("_year", F.explode(F.array(*[F.col("i_year") + d for d in (-1, 0, 1)])))
    c = c.withColumns({"_brand": F.col("c_brand_block"), "_year": F.col("c_year")})
    sides = [(i, c)]
    if "label" in inputs.columns and "label" in known.columns:
        main = cut_lineage(c.groupBy(*base).agg(F.mode("c_label").alias("_main")))

        def split(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
            marked = rows.join(main, base).withColumn("_is_main", F.coalesce(F.col(label) == F.col("_main"), F.lit(False)))
            return tuple(marked.filter(test).drop("_main", "_is_main") for test in (F.col("_is_main"), ~F.col("_is_main")))

        (i_main, i_other), (_, c_other) = split(i, "i_label"), split(c, "c_label")
        sides = [(i_main, c_other), (i_other, c)]
        apart = F.coalesce(F.col("i_label") != F.col("c_label"), F.lit(True))
    else:
        apart = F.lit(True)
    marks = ["check", "condition", "photo"]
    marked = F.lit(False)
    for mark in marks:
        marked = marked | _agree(F.col(f"i_{mark}"), F.col(f"c_{mark}"))
    parts = []

    def case(mine: dict[str, Column], theirs: dict[str, Column], only: Column) -> None:
        """Equi join on the base key and the given columns, which must be known."""
        for left, right in sides:
            for name, col in mine.items():
                left = left.withColumn(name, col).filter(F.col(name).isNotNull())
            for name, col in theirs.items():
                right = right.withColumn(name, col).filter(F.col(name).isNotNull())
            parts.append(left.join(shuffled(right), [*base, *mine]).filter(only & apart).drop("_brand", "_year", *mine))

    i_ref, c_ref = F.col("i_reference"), F.col("c_reference")
    case({"_key": i_ref}, {"_key": c_ref}, ~marked)
    if not same_reference_only:
        earlier = F.lit(False)
        for mark in marks:
            mine, theirs = F.col(f"i_{mark}"), F.col(f"c_{mark}")
            case({"_key": mine}, {"_key": theirs}, ~earlier)
            earlier = earlier | _agree(mine, theirs)

        # Mileages within KM_GAP fall into one of two neighbouring cells; unknown ones into a cell outside all of them.
        i_km, c_km, unknown = F.col("i_km"), F.col("c_km"), F.lit(-(1 << 62)).cast("bigint")
        cells = F.array(F.floor((i_km - KM_GAP) / (2 * KM_GAP)), F.floor((i_km + KM_GAP) / (2 * KM_GAP)), unknown)
        around = F.explode(F.when(~F.col("i_crowded"), cells) if "crowded" in inputs.columns else cells)
        spot = F.coalesce(F.floor(c_km / (2 * KM_GAP)), unknown)
        both = i_ref.isNotNull() & c_ref.isNotNull()
        gap = F.abs(c_km - i_km)
        spec = F.lit(False)
        for name in ["power", "engine", "gearbox"]:
            spec = spec | _agree(F.col(f"i_{name}"), F.col(f"c_{name}"))
        near = F.when(both, (i_ref != c_ref) & (gap <= KM_PROOF)).otherwise(spec & F.coalesce(gap <= KM_GAP, F.lit(True)))
        case({"_cell": around}, {"_cell": spot}, ~marked & near)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Add score, reasons and km_diff to candidate pairs; drop zero scores."""
    i = {c[2:]: F.col(c) for c in pairs.columns if c.startswith("i_")}
    c = {x[2:]: F.col(x) for x in pairs.columns if x.startswith("c_")}
    return pairs.withColumns(identity_score(i, c)).filter(F.col("score") > 0)


#: Score times this, less the id (moved above 0), orders candidates in a number that a hash aggregate can hold.
_RANK, _LIFT = Decimal(10**20), Decimal(2**63)


#: Stored rows of a brand that are paired with each record by a join; above, records and rows are compared as arrays.
DIRECT = 64


def _by_arrays(inputs: DataFrame, known: DataFrame) -> DataFrame:
    """(i_id, c_id, score) of the best candidate by mileage of every input, in each pair of blocks that holds it.

    Marks do not count here; pairs that share one are found by the mark, and score more.
    """

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        model = F.concat_ws("|", F.array_join("model_tokens", " "), F.col("year").cast("string"))
        return rows.filter("year IS NOT NULL").select(
            "id", "reference", "brand_key", "model_tokens", "year", "fuel", "gearbox", "colour", "engine", "power", "fiscal", "km",
            F.col("brand_block").alias("_brand"), model.alias("_model"), F.array_join("version_tokens", " ").alias("version"),
        ).withColumnRenamed("model_tokens", name)

    i, c = keyed(inputs, "i_model_tokens"), keyed(known, "c_model_tokens")
    names = cut_lineage(_matching_models(_prefixed(inputs, "i_"), _prefixed(known, "c_")))
    years = F.explode(F.array(*[F.struct((F.col("year") + d).alias("year"), F.lit(YEAR_POINTS[abs(d)]).alias("points")) for d in (-1, 0, 1)]))
    asked = i.select("_brand", "i_model_tokens", "year", F.col("_model").alias("_qmodel")).distinct().withColumn("_at", years)
    held = c.select("_brand", "c_model_tokens", "year", F.col("_model").alias("_cmodel")).distinct()
    pairs = asked.drop("year").withColumn("year", F.col("_at.year")).join(names, ["_brand", "i_model_tokens"])
    points = F.when(F.col("i_model_overlap") >= 1, MODEL_FULL).otherwise(MODEL_CLOSE) + F.col("_at.points")
    pairs = pairs.join(held, ["_brand", "c_model_tokens", "year"]).select("_brand", "_qmodel", "_cmodel", points.alias("_points"))
    equal = {"fuel": FUEL, "gearbox": GEARBOX, "colour": COLOUR, "engine": ENGINE, "power": POWER, "fiscal": FISCAL}
    run = nearest.best_of(equal, ["power", "engine", "gearbox"], VERSION_BANDS, KM_BANDS, KM_GAP, KM_PROOF)
    kinds = dict(inputs.dtypes)["id"], dict(known.dtypes)["id"]
    sides = i.drop("i_model_tokens", "year"), c.drop("c_model_tokens", "year")
    return block_pairs(*sides, pairs, "id", run, f"i_id {kinds[0]}, c_id {kinds[1]}, score int")


def best_candidates(inputs: DataFrame, known: DataFrame) -> DataFrame:
    """Highest score per input; the lowest candidate id among equals.

    Pairs carry the score alone; reasons are spelt out for the best one. Pairs by mileage alone, which grow with the square
    of the rows of a model, are compared as arrays in brands of more than ``DIRECT`` stored rows.
    """
    many = known.groupBy("brand_block").count().filter(F.col("count") > DIRECT).select("brand_block", F.lit(True).alias("crowded"))
    inputs = cut_lineage(inputs.join(many, "brand_block", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))))
    scored = score_pairs(candidate_pairs(inputs, known)).select("i_id", "c_id", "score")
    if not many.isEmpty():
        scored = scored.unionByName(_by_arrays(inputs.filter("crowded"), known))
    rank = F.col("score").cast("decimal(5,0)") * _RANK - (F.col("c_id").cast("decimal(20,0)") + _LIFT)
    best = scored.groupBy("i_id").agg(F.max(rank).alias("_rank"))
    best = best.select("i_id", (F.pmod(-F.col("_rank"), _RANK) - _LIFT).cast("bigint").alias("c_id"))
    rows = best.join(_prefixed(inputs, "i_"), "i_id").join(_prefixed(known, "c_"), "c_id")
    return score_pairs(rows).select(F.col("i_id").alias("id"), F.col("c_id").alias("vehicle_id"), "score", "reasons", "km_diff")


def _signature(*names: str) -> Column:
    """A hash that is equal exactly where all the columns are; each is written with its length, NULL as a dash."""
    texts = [F.array_join(n, " ") if n.endswith("_tokens") else F.col(n).cast("string") for n in names]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _kinds(rows: DataFrame, reference: str) -> DataFrame:
    """``rows`` in scored form with ``sig``, equal exactly for rows that score alike where no two references are equal.

    A known reference becomes ``reference``.
    """
    rows = rows.withColumn("reference", F.when(F.col("reference").isNotNull(), F.lit(reference)))
    return rows.withColumn("sig", _signature("reference", *SCORED))


def resolve(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity of every incoming record.

    Cascade: reference, then strong details over the owner of the hash (which
    is then a duplicate), then the hash, then strong details, else new.
    All records of a batch resolve against the same stored entities.
    """
    refs = entities.filter(blank_to_null(F.col("reference")).isNotNull()).groupBy("reference").agg(
        F.min("id").alias("_by_ref")
    )
    hashes = entities.filter(blank_to_null(F.col("hash_id")).isNotNull()).groupBy("hash_id").agg(
        F.min("id").alias("_by_hash")
    )
    known = records.select("id", "reference", "hash_id").join(refs, "reference", "left").join(hashes, "hash_id", "left")
    open_ids = known.filter(F.col("_by_ref").isNull()).select("id")
    open_records = records.join(open_ids, "id", "left_semi")
    # No stored entity has the reference of an open record, so equal rows of either side need one score.
    asked = cut_lineage(_kinds(incoming(open_records, F.col("brand")), "<"))
    facts = [F.first(c).alias(c) for c in ["reference", *SCORED]]
    kinds = cut_lineage(asked.groupBy("sig").agg(*facts).withColumnRenamed("sig", "id"))
    known_kinds = _kinds(stored(entities, F.col("brand")), ">").groupBy("sig").agg(F.min("id").alias("id"), *facts)
    found = best_candidates(kinds, cut_lineage(known_kinds.drop("sig"))).withColumnRenamed("id", "sig")
    best = asked.select("id", "sig").join(found, "sig").select(
        "id", F.col("vehicle_id").alias("_best"), F.col("score").alias("_score"),
        F.col("reasons").alias("_reasons"), "km_diff",
    )
    rows = known.join(best, "id", "left")
    by_ref, by_hash, found = F.col("_by_ref"), F.col("_by_hash"), F.col("_best")
    strong = F.coalesce(is_strong(F.col("_score"), F.col("km_diff")), F.lit(False))
    replaces = by_hash.isNotNull() & (found != by_hash) & (F.col("_score") >= STRONG)
    replaces = F.coalesce(replaces, F.lit(False))
    same = F.coalesce(found == by_hash, F.lit(False))
    case = (
        F.when(by_ref.isNotNull(), F.lit("reference"))
        .when(replaces, F.lit("details"))
        .when(by_hash.isNotNull(), F.lit("hash"))
        .when(strong, F.lit("details"))
    )
    rows = rows.withColumn("matched_by", case)
    by = F.col("matched_by")
    return rows.select(
        "id", "matched_by",
        F.when(by == "reference", by_ref).when(by == "hash", by_hash).when(by == "details", found).alias("vehicle_id"),
        F.when((by == "details") & replaces, by_hash).alias("duplicate_id"),
        F.when(by == "reference", F.lit(100)).when(by == "details", F.col("_score"))
        .when(by == "hash", F.when(same, F.col("_score")).otherwise(F.lit(HASH_SCORE))).alias("score"),
        F.when(by == "reference", F.array(F.lit("same_reference"))).when(by == "details", F.col("_reasons"))
        .when(by == "hash", F.when(same, F.col("_reasons")).otherwise(F.array(F.lit("same_hash")))).alias("reasons"),
    )


def _nodes(entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of equal entities, those that keep their reference, and the members (id, sig) of both.

    The lower id of a pair is read as the incoming record. A link from node A
    to node B therefore holds for every a in A and b in B with a < b. Of the
    reference, a node only keeps whether it exists: between two different
    references the score does not depend on which. Pairs with the same
    reference are found among nodes that keep it; those that share a mark or
    are within 500 km are linked as nodes without it already.
    """
    alive = entities.filter(F.col("l_mileage").isNotNull())
    block = F.upper("brand")
    as_new = stored_as_incoming(alive, block)
    as_old = stored(alive, block).drop("reference")
    both = as_new.join(shuffled(as_old.select("id", *[F.col(c).alias("s_" + c) for c in SCORED])), "id")
    has_ref = F.col("reference").isNotNull()
    facts = [*SCORED, *["s_" + c for c in SCORED]]
    # Different stand-ins on the two sides make existing references differ.
    plain = both.withColumn("has_ref", has_ref).withColumn("sig", _signature("has_ref", *facts)).drop("has_ref")
    shared = both.filter(has_ref).groupBy("reference").agg(F.count("*").alias("_n")).filter("_n > 1").select("reference")
    named = both.join(shuffled(shared), "reference", "left_semi").withColumn("sig", _signature("reference", *facts))

    def nodes(rows: DataFrame) -> DataFrame:
        return cut_lineage(
            rows.groupBy("sig").agg(
                F.min("id").alias("lo"), F.max("id").alias("hi"),
                *[F.first(c).alias(c) for c in ["reference", *facts]],
            )
        )

    members = cut_lineage(plain.select("id", "sig").unionByName(named.select("id", "sig")))
    return nodes(plain), nodes(named), members


_ENDS = ["sig", "lo", "hi"]

def _other_references() -> list[Column]:
    """Stand-ins for the reference of the incoming and the stored side, which never agree."""
    return [F.when(F.col("reference").isNotNull(), F.lit(x)).alias("reference") for x in "<>"]


def _as_links(pairs: DataFrame) -> DataFrame:
    """Strong pairs of nodes as links (a, a_lo, b, b_hi)."""
    scored = score_pairs(pairs.filter(F.col("i_lo") < F.col("c_hi")))
    return scored.filter(is_strong(F.col("score"), F.col("km_diff"))).select(
        F.col("i_sig").alias("a"), F.col("i_lo").alias("a_lo"), F.col("c_sig").alias("b"), F.col("c_hi").alias("b_hi"),
    )


def _near_links(nodes: DataFrame) -> DataFrame:
    """Strong links between nodes that follow each other by mileage; a number linear in that of nodes.

    Neighbours are nodes of one model and of one year or two in a row: with
    the same power, engine or gearbox the next node without a reference on
    either side, and among nodes with one the one before.
    """
    old = [F.col("s_" + c).alias(c) for c in SCORED]
    as_new, as_old = F.struct(*_ENDS, *SCORED, _other_references()[0]), F.struct(*_ENDS, *old, _other_references()[1])
    years = F.explode(F.array(F.col("year"), F.col("year") - 1))
    rows = nodes.select(
        "brand_block", "model_tokens", "km", "lo", "power", "engine", "gearbox", F.col("reference").isNotNull().alias("has_ref"),
        F.struct(as_new.alias("i"), as_old.alias("c")).alias("me"), years.alias("_years"),
    ).filter("brand_block IS NOT NULL AND size(model_tokens) > 0")
    key = ["brand_block", "model_tokens", "_years"]
    beside = []
    for spec in ["power", "engine", "gearbox"]:
        alike = Window.partitionBy(*key, spec)
        free = F.when(~F.col("has_ref"), F.col("me"))
        last = F.last(free, ignorenulls=True)
        up, down = (alike.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (
            ["km", "lo"], [F.col("km").desc(), F.col("lo").desc()]
        ))
        beside.append(
            rows.filter(F.col(spec).isNotNull())
            .select("me", last.over(up).alias("up"), last.over(down).alias("down"))
            .select("me", F.explode(F.array("up", "down")).alias("other"))
        )
    named = Window.partitionBy(*key).orderBy("km", "lo")
    beside.append(rows.filter("has_ref").select("me", F.lag("me").over(named).alias("other")))
    links = []
    for pairs in beside:
        pairs = pairs.filter("other IS NOT NULL").select(
            F.explode(F.array(
                F.struct(F.col("me.i").alias("i"), F.col("other.c").alias("c")),
                F.struct(F.col("other.i").alias("i"), F.col("me.c").alias("c")),
            )).alias("p")
        )
        names = [*_ENDS, *SCORED, "reference"]
        links.append(_as_links(pairs.select(*[F.col(f"p.{s}.{n}").alias(f"{s}_{n}") for s in "ic" for n in names])))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (src, dst) between entities that connect what the links between their nodes connect.

    A link A to B is expanded without forming all pairs: its extreme members
    are connected, and every further member attaches to the extreme of its own
    node that it shares a partner with.
    """
    links = cut_lineage(links)
    across = links.select(F.col("a_lo").alias("src"), F.col("b_hi").alias("dst"))
    low = links.groupBy(F.col("a").alias("sig")).agg(F.max("b_hi").alias("_below"), F.min("a_lo").alias("hub"))
    high = links.groupBy(F.col("b").alias("sig")).agg(F.min("a_lo").alias("_above"), F.max("b_hi").alias("hub"))
    lower = members.join(shuffled(low), "sig").filter((F.col("id") < F.col("_below")) & (F.col("id") != F.col("hub")))
    upper = members.join(shuffled(high), "sig").filter((F.col("id") > F.col("_above")) & (F.col("id") != F.col("hub")))
    return (
        across
        .unionByName(lower.select(F.col("hub").alias("src"), F.col("id").alias("dst")))
        .unionByName(upper.select(F.col("id").alias("src"), F.col("hub").alias("dst")))
        .filter(F.col("src") != F.col("dst"))
    )


def duplicate_edges(entities: DataFrame) -> DataFrame:
    """Edges (src, dst) whose connected components are the duplicate clusters.

    Links between neighbours come first. What they connect needs no further
    link: nodes whose members all lie in one component carry its id as their
    label, and all other pairs are formed only where the labels differ.
    """
    plain, named, members = _nodes(entities)
    near = connected_components(_expanded(_near_links(plain), members))
    spread = members.join(shuffled(near), "id", "left").groupBy("sig").agg(
        F.min("cluster").alias("_lo"), F.max("cluster").alias("_hi"), F.count_if(F.col("cluster").isNull()).alias("_open")
    )
    labels = cut_lineage(
        spread.select("sig", F.when((F.col("_open") == 0) & (F.col("_lo") == F.col("_hi")), F.col("_lo")).alias("label"))
    )

    def rest(nodes: DataFrame, references: list[Column], same_reference_only: bool) -> DataFrame:
        rows = nodes.join(shuffled(labels), "sig")
        left = rows.select(*_ENDS, "label", *SCORED, references[0])
        right = rows.select(*_ENDS, "label", *[F.col("s_" + c).alias(c) for c in SCORED], references[1])
        return _as_links(candidate_pairs(left, right, same_reference_only))

    links = rest(plain, _other_references(), False).unionByName(rest(named, [F.col("reference")] * 2, True))
    stars = near.filter("id <> cluster").select(F.col("cluster").alias("src"), F.col("id").alias("dst"))
    return stars.unionByName(_expanded(links, members))


#: Edges that one task may solve.
LOCAL_EDGES = 1 << 17


def _solved(graph: DataFrame) -> DataFrame:
    """(id, root) of every node of a graph of at most ``LOCAL_EDGES`` edges, in one task."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = list(batches)
        if not edges:
            return
        ends = [pa.chunked_array([b[c] for b in edges]).to_numpy(zero_copy_only=False) for c in ("src", "dst")]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        left, right = np.split(at.ravel(), 2)
        # Places are in the order of ids, so the smallest place names the smallest id.
        root = np.arange(len(nodes))
        while True:
            low, before = np.minimum(root[left], root[right]), root.copy()
            np.minimum.at(root, before[left], low)
            np.minimum.at(root, before[right], low)
            root = root[root]
            if (root == before).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(nodes, edges[0]["src"].type), pa.array(nodes[root], edges[0]["src"].type)], ["id", "root"])

    kind = dict(graph.dtypes)["src"]
    return graph.coalesce(1).mapInArrow(solve, f"id {kind}, root {kind}")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, cluster) for every node of ``edges``; cluster is the smallest id.

    Each round hooks every node to its smallest neighbour, shortens the
    resulting chains by doubling, and contracts the graph. Chains and rounds
    are logarithmic in the size of a component, and every aggregate combines
    on the map side, so a hub of many edges is no hot spot. Once at most
    ``LOCAL_EDGES`` edges are left, one task finishes them: that is a bounded
    piece of work, and saves the many small jobs of the last rounds.
    """
    graph = cut_lineage(edges.select("src", "dst").distinct())
    labels = None
    while (left := graph.count()) > LOCAL_EDGES:
        both = graph.unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        parent = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("_p")).select(
            "id", F.least("id", "_p").alias("parent")
        )
        parent = cut_lineage(parent)
        while True:
            up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("_up"))
            jumped = cut_lineage(parent.join(shuffled(up), "parent").select("id", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("moved")))
            moved = not jumped.filter("moved").isEmpty()
            parent = jumped.drop("moved")
            if not moved:
                break
        labels = parent.select("id", F.col("parent").alias("cluster")) if labels is None else cut_lineage(
            labels.join(shuffled(parent.withColumnRenamed("id", "cluster")), "cluster", "left")
            .select("id", F.coalesce("parent", "cluster").alias("cluster"))
        )
        a = parent.select(F.col("id").alias("src"), F.col("parent").alias("_a"))
        b = parent.select(F.col("id").alias("dst"), F.col("parent").alias("_b"))
        graph = cut_lineage(
            graph.join(shuffled(a), "src").join(shuffled(b), "dst").filter(F.col("_a") != F.col("_b"))
            .select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()
        )
    if labels is None:
        return cut_lineage(_solved(graph).withColumnRenamed("root", "cluster"))
    if not left:
        return labels
    rest = cut_lineage(_solved(graph)).withColumnRenamed("id", "cluster")
    return cut_lineage(labels.join(rest, "cluster", "left").select("id", F.coalesce("root", "cluster").alias("cluster")))


def merge_mapping(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """(old_id, new_id) per cluster member.

    Canonical is the member with a reference, the lowest numeric one first,
    then the lowest id.
    """
    number = F.col("reference").try_cast("double")
    rank = F.struct(
        blank_to_null(F.col("reference")).isNull().alias("no_ref"), number.isNull().alias("no_number"),
        number.alias("number"), F.col("id").alias("id"),
    )
    ranked = clusters.join(shuffled(entities.select("id", "reference")), "id")
    canonical = ranked.groupBy("cluster").agg(F.min(rank)["id"].alias("new_id"))
    return clusters.join(shuffled(canonical), "cluster").select(F.col("id").alias("old_id"), "new_id", "cluster")


def merge_clusters(entities: DataFrame, snap: DataFrame, mapping: DataFrame) -> DataFrame:
    """Surviving entities with their last sighting over all merged snapshots."""
    to = mapping.select(F.col("old_id").alias("vehicle_id"), "new_id")
    seen = (
        snap.groupBy("vehicle_id").agg(F.max("scraped_at").alias("_seen")).join(to, "vehicle_id")
        .groupBy(F.col("new_id").alias("id")).agg(F.max("_seen").alias("_seen"))
    )
    gone = mapping.filter(F.col("old_id") != F.col("new_id")).select(F.col("old_id").alias("id"))
    return (
        entities.join(gone, "id", "left_anti").join(seen, "id", "left")
        .withColumn("last_seen_at", F.coalesce("_seen", "last_seen_at")).drop("_seen")
    )


def cluster_summary(mapping: DataFrame, snap: DataFrame) -> DataFrame:
    """Clusters, entities to delete and snapshots to move."""
    per_entity = snap.groupBy(F.col("vehicle_id").alias("old_id")).agg(F.count("*").alias("_n"))
    away = F.col("old_id") != F.col("new_id")
    return mapping.join(per_entity, "old_id", "left").agg(
        F.count_distinct("cluster").alias("clusters"),
        F.count_if(away).alias("deleted"),
        F.coalesce(F.sum(F.when(away, F.col("_n"))), F.lit(0)).alias("moved_snapshots"),
    )

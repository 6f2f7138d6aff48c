"""Identity gates, blocking and clustering against brute force."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from hammertrail.operators import identity as I

BASE = {"brand": "FORD", "model": "Puma 1.0", "version": "Flexifuel 125 ch ST-Line X", "year": 2023, "color": "Gris",
        "fuel": "FH", "transmission": "", "engine_size": 999, "power": 125, "fiscal_power": None}
MARKS = {"technical_check_url": None, "condition_image_url": None, "photo_hash": None}
TYPES = {"year": "int", "engine_size": "int", "power": "int", "fiscal_power": "int", "mileage": "long", "id": "long"}


def frame(spark, rows):
    names = list(rows[0])
    schema = ", ".join(f"{n} {TYPES.get(n.removeprefix('l_'), 'string')}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def stored_row(**change):
    row = {"id": 1, "reference": "11395424", "hash_id": "h1", **BASE}
    row |= {"l_" + k: BASE.get(k) for k in ["color", "fuel", "transmission", "engine_size", "power", "fiscal_power"]}
    row |= {"l_" + k: v for k, v in MARKS.items()} | {"l_mileage": 50496}
    return row | change


def score(spark, incoming=None, **change):
    record = {"id": 9, "reference": "11395424", **BASE, "mileage": 50496, **MARKS} | (incoming or {})
    i = I.incoming(frame(spark, [record]), F.col("brand"))
    c = I.stored(frame(spark, [stored_row(**change)]), F.col("brand"))
    pair = i.select(*[F.col(x).alias("i_" + x) for x in i.columns]).join(c.select(*[F.col(x).alias("c_" + x) for x in c.columns]), F.lit(True))
    out = I.identity_score({x: F.col("i_" + x) for x in i.columns}, {x: F.col("c_" + x) for x in c.columns})
    row = pair.select(*[v.alias(k) for k, v in out.items()]).first()
    return row["score"], row["reasons"]


def test_same_vehicle_scores_high(spark):
    points, reasons = score(spark)
    assert points >= 70 and {"same_model", "same_year", "km_very_close"} <= set(reasons)


def test_gates(spark):
    assert score(spark, brand="BMW") == (0, ["brand_mismatch"])
    assert score(spark, model="Fiesta") == (0, ["model_mismatch"])
    assert score(spark, year=2020) == (0, ["year_mismatch"])
    assert score(spark, l_mileage=130000)[0] == 0
    assert score(spark, {"technical_check_url": "u"}, l_mileage=130000, l_technical_check_url="u")[0] > 0
    assert score(spark, {"reference": "2"}, l_mileage=50600)[1][-1] == "cross_reference_accepted"
    assert score(spark, {"reference": "2"}, l_mileage=52000)[0] == 0
    bare = {"reference": None, "power": None, "engine_size": None}
    assert score(spark, bare)[1][-1] == "no_reference_no_discriminator"


def cars(n, seed=1):
    """Near duplicates with many exact copies: one profile holds a third."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        row = stored_row(
            id=i, reference=None if rng.random() < 0.5 else f"R{rng.randrange(n // 2)}", hash_id=f"h{i}",
            model="Puma" if hot else rng.choice(["Puma ST", "Puma ST Line", "Kuga Vignale"]),
            version=rng.choice(["ST-Line X", "Titanium"]), year=2023 if hot else rng.choice([2021, 2022, 2023, 2024]),
            power=125 if hot else rng.choice([None, 125, 155]), transmission=rng.choice(["", "BVA8"]),
            l_mileage=40000 if hot else rng.choice([None, *range(30000, 50000, 700)]),
            l_photo_hash=rng.choice([None, None, None, f"p{rng.randrange(9)}"]),
        )
        row["l_power"], row["l_transmission"] = row["power"], rng.choice(["", row["transmission"]])
        rows.append(row)
    return rows


def brute(spark, rows):
    alive = frame(spark, rows).filter("l_mileage is not null")
    i = I.stored_as_incoming(alive, F.upper("brand"))
    c = I.stored(alive, F.upper("brand"))
    pairs = i.select(*[F.col(x).alias("i_" + x) for x in i.columns]).join(
        c.select(*[F.col(x).alias("c_" + x) for x in c.columns]), F.col("i_id") < F.col("c_id")
    )
    hits = I.score_pairs(pairs).filter(I.is_strong(F.col("score"), F.col("km_diff"))).select("i_id", "c_id").collect()
    return {(r[0], r[1]) for r in hits}


def components(edges):
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        label[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(label)}


def test_blocking_finds_every_strong_pair(spark):
    rows = cars(90)
    alive = frame(spark, rows).filter("l_mileage is not null")
    pairs = I.candidate_pairs(I.stored_as_incoming(alive, F.upper("brand")), I.stored(alive, F.upper("brand")))
    scored = I.score_pairs(pairs.filter("i_id < c_id"))
    hits = scored.filter(I.is_strong(F.col("score"), F.col("km_diff"))).select("i_id", "c_id").collect()
    got = [(r[0], r[1]) for r in hits]
    assert len(got) == len(set(got))
    assert set(got) == brute(spark, rows)


def test_clusters_equal_brute_force(spark):
    rows = cars(120, 5)
    edges = I.duplicate_edges(frame(spark, rows))
    assert edges.count() < 8 * len(rows)
    got = {r["id"]: r["cluster"] for r in I.connected_components(edges).collect()}
    assert got == components(brute(spark, rows))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)]
    got = {r["id"]: r["cluster"] for r in I.connected_components(spark.createDataFrame(path, "src long, dst long")).collect()}
    assert got == components(path)


@pytest.mark.parametrize("bound", [1 << 17, 40, 0])
def test_components_in_one_task_and_by_rounds(spark, monkeypatch, bound):
    monkeypatch.setattr(I, "LOCAL_EDGES", bound)
    rng = random.Random(bound)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(130)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in edges]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    made = I.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {r["id"]: r["cluster"] for r in made} == root and len(made) == len(root)
    assert I.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_one_model_of_many_near_cars_costs_a_linear_number_of_edges(spark):
    rows = [stored_row(id=n, reference=f"r{n}" if n % 3 else None, l_mileage=50000 + 37 * n, hash_id=f"h{n}") for n in range(150)]
    edges = I.duplicate_edges(frame(spark, rows))
    # Every pair is strong, and one link for each would be some 11,000.
    assert edges.count() < 8 * len(rows)
    got = {r["id"]: r["cluster"] for r in I.connected_components(edges).collect()}
    assert got == dict.fromkeys(range(150), 0)


def test_equal_records_are_resolved_once(spark, monkeypatch):
    formed, pairs_of = [], I.candidate_pairs

    def counted(*args):
        pairs = pairs_of(*args)
        formed.append(pairs.count())
        return pairs

    monkeypatch.setattr(I, "candidate_pairs", counted)
    entities = frame(spark, [stored_row(id=n, reference=None, hash_id=f"h{n}") for n in range(5, 25)])
    record = {"reference": None, "hash_id": None, **BASE, "mileage": 50700, **MARKS}
    rows = I.resolve(frame(spark, [{"id": n, **record} for n in range(-10, 10)]), entities).collect()
    assert formed == [1]
    assert {(r["matched_by"], r["vehicle_id"]) for r in rows} == {("details", 5)} and len(rows) == 20


def test_crowded_brands_form_no_pairs_by_mileage(spark, monkeypatch):
    inputs = I.stored_as_incoming(frame(spark, cars(130, 7)), F.upper("brand"))
    known = I.stored(frame(spark, cars(150, 8)), F.upper("brand"))
    formed, pairs_of = [], I.candidate_pairs

    def counted(*args):
        pairs = pairs_of(*args)
        formed.append(pairs.count())
        return pairs

    monkeypatch.setattr(I, "candidate_pairs", counted)
    monkeypatch.setattr(I.nearest, "STRIP", 500)
    names = ["i_" + c for c in inputs.columns], ["c_" + c for c in known.columns]
    every = I.score_pairs(inputs.toDF(*names[0]).crossJoin(known.toDF(*names[1]))).select("i_id", "c_id", "score", "km_diff").collect()
    best = {}
    for r in sorted(every, key=lambda r: (r["score"], -r["c_id"])):
        best[r["i_id"]] = (r["c_id"], r["score"], r["km_diff"])
    found = I.best_candidates(inputs, known).collect()
    assert {r["id"]: (r["vehicle_id"], r["score"], r["km_diff"]) for r in found} == best and len(found) == len(best)
    # Marks and references only; all pairs that the score accepts are several times as many.
    assert formed[0] < len(every) / 4


def _joins(frame):
    """The plan that Spark has chosen at the end of a run."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_sides_that_grow_are_not_collected_in_the_driver(spark, monkeypatch):
    seen = []

    def kept(frame):
        seen.append(_joins(frame))
        return frame.localCheckpoint()

    monkeypatch.setattr(I, "cut_lineage", kept)
    monkeypatch.setattr(I, "LOCAL_EDGES", 1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21), (21, 22)], "src long, dst long")
    found = {r["id"]: r["cluster"] for r in I.connected_components(edges).collect()}
    assert found == {i: 1 for i in range(1, 10)} | {i: 20 for i in (20, 21, 22)}
    links = spark.createDataFrame([("a", 1, "b", 9)], "a string, a_lo long, b string, b_hi long")
    members = spark.createDataFrame([(1, "a"), (2, "a"), (9, "b"), (8, "b")], "id long, sig string")
    expanded = I._expanded(links, members)
    assert {tuple(r) for r in expanded.collect()} == {(1, 9), (1, 2), (8, 9)}
    seen.append(_joins(expanded))
    assert any("SortMergeJoin" in plan for plan in seen) and not any("Broadcast" in plan for plan in seen)


def test_merge_mapping_collects_nothing_in_the_driver(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (7, 7)], "id long, cluster long")
    entities = spark.createDataFrame([(1, None), (2, "R2"), (7, None)], "id long, reference string")
    mapping = I.merge_mapping(entities, clusters)
    assert "Broadcast" not in _joins(mapping)
    assert sorted(tuple(r) for r in mapping.select("old_id", "new_id").collect()) == [(1, 2), (2, 2), (7, 7)]

"""Block scores against the column expressions over all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hammertrail.functions import prices as P
from hammertrail.operators import blocks
from hammertrail.operators import similar as S

SCHEMA = (
    "id long, brand string, model string, version string, year long, mileage long, color string, fuel string, transmission string, "
    "engine_size long, power long, status string, starting_price long, auction_id long, hash_id string, reference string, source_url string"
)


@pytest.fixture()
def items(spark):
    dice = random.Random(7)

    def row(i):
        pick = dice.choice
        return (
            i, pick(["A", "a", "B"]), pick(["GOLF", "golf", "GOLF GTI", "", "POLO"]), pick(["", "x", "X", "y", None]), pick([2010, 2011, 2012, 2015, None]),
            pick([0, 400, 5000, 15001, 40000, None]), pick(["", "noir", None]), pick(["GO", "go", "ES", None]), pick(["BVA", "", None]),
            pick([0, 1000, 1200, None]), pick([0, 60, 85, 86, 150, None]), pick(["available", "auction_live", "unsold", "sold"]),
            pick([0, 100, 100, 250, None]), pick([1, 2, 3, None]), pick(["", "h1", f"h{i}", None]), pick(["", "r1", f"r{i}", None]), pick(["u1", f"u{i}", f"v{i}", None]),
        )

    return spark.createDataFrame([row(i) for i in range(130)], SCHEMA).cache()


def all_pairs(items):
    q, c = (items.select(*[F.col(x).alias(side + x) for x in items.columns]) for side in ("q_", "c_"))
    pairs = q.crossJoin(c).filter("q_id <> c_id").withColumn("score", S.similarity_score(S.side("q_"), S.side("c_")))
    return pairs.filter("score >= 40").withColumn("level", P.match_level(F.col("score")))


def test_levels_of_all_pairs_in_small_blocks(items, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    monkeypatch.setattr(blocks, "GROUP", 16)
    levels = [F.count_if(F.col("level") == x).alias(f"n_{x}") for x in ("exact", "same_model", "similar")]
    counts = all_pairs(items).groupBy(F.col("q_id").alias("id")).agg(*levels, F.max("score").alias("best_score"))
    expected = items.select("id").join(counts, "id", "left").na.fill(0, [f"n_{x}" for x in ("exact", "same_model", "similar")])
    got = S.match_summary(items)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_best_offers_of_all_pairs_in_small_blocks(items, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    monkeypatch.setattr(blocks, "GROUP", 16)
    names = ["brand", "model", "year", "mileage", "hash_id", "reference", "source_url"]
    own = F.coalesce(F.col("c_hash_id").isNotNull() & (F.col("q_auction_id") == F.col("c_auction_id")), F.lit(False))
    fit = all_pairs(items).filter((F.col("level") != "exact") & F.col("c_status").isin(S.OFFER_STATUSES) & ~own)
    fit = fit.filter(~S.same_vehicle(S.side("q_", names), S.side("c_", names)))
    expected = {}
    for r in fit.collect():
        diff = r.c_starting_price - r.q_starting_price if r.c_starting_price is not None and r.q_starting_price else None
        free = {"available": 0, "auction_live": 1}.get(r.c_status, 2)
        key = (r.level != "same_model", free, diff is None, diff or 0, -r.score, r.c_id)
        expected.setdefault(r.q_id, []).append((key, r.c_id, r.score, diff))
    expected = {(q, i): x[1:] for q, rows in expected.items() for i, x in enumerate(sorted(rows)[:3], 1)}
    got = {(r["id"], r["rank"]): (r.offer_id, r.score, r.price_diff) for r in S.offers_elsewhere(items, 3).collect()}
    assert got == expected and got


def test_pairs_of_items_are_no_rows(items):
    plan = S.match_summary(items)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("mileage" in line or "contains" in line.lower() for line in joins)

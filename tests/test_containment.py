"""Texts that hold other texts: the index against every pair, and its growth."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hammertrail.operators import containment, similar
from hammertrail.operators.similar import model_pairs, peers_in_auction

words = st.one_of(st.none(), st.text("abé ", max_size=7))
rows = st.lists(st.tuples(st.sampled_from(["k", "l", None]), words), max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sought=rows, texts=rows, few=st.sampled_from([0, 3]))
def test_holding_finds_every_pair(spark, sought, texts, few):
    a = spark.createDataFrame(sought, "k string, n string")
    b = spark.createDataFrame(texts, "k string, t string")
    want = {
        (k, n, t) for k, n in sought for j, t in texts
        if k is not None and k == j and n is not None and t is not None and n in t
    }
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(containment, "FEW_TEXTS", few)
        got = [tuple(r) for r in containment.holding(a, b, ["k"], "n", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_names_of_one_brand_do_not_meet_all_others(spark):
    """20000 names share a long beginning; only the rare runs of each are looked up."""
    names = spark.range(20000).select(
        F.lit("hot").alias("brand"), F.concat(F.lit("Model "), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("model")
    )
    assert model_pairs(names).count() == 20000


@pytest.mark.parametrize("few", [0, 64])
def test_peers_beyond_the_fitting_ones(spark, monkeypatch, few):
    """Peers by definition: fitting first, then cheap, at most k of one listing."""
    monkeypatch.setattr(similar, "FEW_TEXTS", few)
    monkeypatch.setattr(containment, "FEW_TEXTS", few)
    lots = [
        (i, "a", "B", ["Clio RS", "Clio", "Megane", "", "Twingo"][i % 5], f"h{i % 7}" if i % 6 else None, (i * 37) % 50)
        for i in range(60)
    ]
    frame = spark.createDataFrame(
        [(*r, None, "available") for r in lots],
        "id long, auction_id string, brand string, model string, hash_id string, starting_price long, sold_price long, status string",
    )
    k = 4
    got = {r["id"]: [p["id"] for p in r["peers"]] for r in peers_in_auction(frame, k).collect()}
    for own, _, _, model, mark, _ in lots:
        word = (model.upper().split() or [""])[0]
        ranked = sorted(lots, key=lambda r: (word not in r[3].upper(), r[5], r[0]))
        taken, held = [], {}
        for r in ranked:
            held[r[4]] = held.get(r[4], 0) + 1
            if held[r[4]] <= k and len(taken) < 2 * k:
                taken.append(r)
        assert got[own] == [r[0] for r in taken if r[4] != mark][:k], own

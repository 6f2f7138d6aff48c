"""Offers elsewhere: many copies of an item's own listing must not hide other offers."""

from __future__ import annotations

import random

import pytest

from hammertrail.operators.similar import offers_elsewhere

SCHEMA = (
    "id long, brand string, model string, version string, year int, mileage long, color string, fuel string, "
    "transmission string, engine_size long, power long, hash_id string, reference string, source_url string, "
    "status string, starting_price long, auction_id string"
)


def item(n, hash_id, reference=None, url=None, mileage=90000, auction="b"):
    colour, version = ("BLANC", "LIFE") if auction == "a" else ("GRIS", "ZEN")
    return (n, "RENAULT", "CLIO", version, 2018, mileage, colour, "ESSENCE", "MANUELLE", 999, 90,
            hash_id, reference, url, "available", 4000, auction)


def offers(spark, rows, k):
    found = offers_elsewhere(spark.createDataFrame(rows, SCHEMA), k).filter(f"rank <= {min(k, 8)}")
    return {(r.id, r.rank): r.offer_id for r in found.collect()}


@pytest.mark.parametrize("copies", [12, 300])
def test_copies_of_the_own_hash(spark, copies):
    rows = [item(1, "own", mileage=40000, auction="a")]
    rows += [item(2 + c, "own") for c in range(copies)] + [item(1001 + c, f"h{c}") for c in range(5)]
    found = offers(spark, rows, 8)
    assert [found.get((1, r)) for r in range(1, 7)] == [1001, 1002, 1003, 1004, 1005, None]


def test_every_cut_keeps_the_first_offers(spark):
    """One group of 120 offers with few hashes, references and addresses, against no cut at all."""
    draw = random.Random(3)
    some = ["x", "y", "z", "", None]
    rows = [item(n, draw.choice(some), draw.choice(some), draw.choice(some), auction="b") for n in range(100, 220)]
    rows += [item(n, draw.choice(some), draw.choice(some), draw.choice(some), 40000, "a") for n in range(1, 30)]
    whole = offers(spark, rows, 1000)
    for k in (1,):
        assert offers(spark, rows, k) == {key: v for key, v in whole.items() if key[1] <= k}

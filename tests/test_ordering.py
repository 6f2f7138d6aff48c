"""The chunked helpers equal plain windows, also with one hot key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hammertrail.operators import ordering as O


@pytest.fixture(params=[1 << 16, 20], ids=["by day", "hot days"])
def rows(spark, request, monkeypatch):
    monkeypatch.setattr(O, "HOT_ROWS", request.param)
    rng = random.Random(3)
    data = [(i, 0 if i % 3 else rng.randrange(6), rng.randrange(400), rng.choice([None, 1, 2, 3])) for i in range(900)]
    return spark.createDataFrame(data, "id long, k long, t long, v long")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_previous(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    got = O.with_previous(rows, ["k"], F.floor(F.col("t") / 50), [F.col("t"), F.col("id")], F.struct("v", "id"), "p")
    assert same(got.select("id", "p.v", "p.id"), rows.withColumn("p", F.lag(F.struct("v", "id")).over(w)).select("id", "p.v", "p.id"))


def test_next(rows):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(1, Window.unboundedFollowing)
    got = O.with_next(rows, ["k"], F.floor(F.col("t") / 50), ["t", "id"], F.col("v"), "n")
    assert same(got.select("id", "n"), rows.withColumn("n", F.first("v", ignorenulls=True).over(w)).select("id", "n"))


def test_positions(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    got = O.positions(rows, ["k"], F.floor(F.col("t") / 50), [F.col("t"), F.col("id")], "n")
    assert same(got.select("id", "n"), rows.withColumn("n", F.row_number().over(w)).select("id", "n"))


def test_a_hot_day_is_spread(spark, monkeypatch):
    """A third of all rows under one key on one day: no part holds more than twice the mean of the parts."""
    monkeypatch.setattr(O, "HOT_ROWS", 100)
    df = spark.range(6000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id", "pmod(id * 7919, 1000) AS t")
    made = O._chunked(df, ["k"], F.lit(1), [F.col("t"), F.col("id")]).filter("k = 0").groupBy("_chunk").count()
    counts = [r["count"] for r in made.collect()]
    assert len(counts) > 2 and sum(counts) == 2000 and max(counts) < 2 * sum(counts) / len(counts)

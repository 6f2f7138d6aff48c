"""Peers of a lot against a plain loop, in small and in large groups."""

import random

from hammertrail.operators import similar as S

SCHEMA = "id string, auction_id long, hash_id string, brand string, model string, starting_price long, sold_price long, status string"


def _lots():
    rnd = random.Random(3)
    models = ["GOLF V", "golf plus", "POLO", "GOLF", None]
    return [
        (f"i{i:03}", rnd.choice([1, 1, 1, 2, 3, 3, None]), rnd.choice(["a", "b", None, f"h{i}"]), rnd.choice(["B", "b", None]),
         rnd.choice(models), rnd.choice([None, 100, 200, 300]), None, "available")
        for i in range(260)
    ]


def _expected(lots, k):
    out = {}
    for me in lots:
        if me[1] is None or me[3] is None or me[4] is None:
            continue
        word = me[4].upper().split()[0]
        rows = [r for r in lots if r[1] == me[1] and r[3] and r[3].upper() == me[3].upper() and r[2] != me[2]]
        match = {r[0]: None if r[4] is None else word in r[4].upper() for r in rows}
        rows.sort(key=lambda r: ({True: 0, False: 1, None: 2}[match[r[0]]], r[5] or 0, r[0]))
        out[me[0]] = [(r[0], match[r[0]]) for r in rows[:k]]
    return out


def test_small_and_large_groups(spark):
    lots = _lots()
    sizes = [sum(r[1] == a and r[3] is not None for r in lots) for a in (1, 2, 3)]
    assert min(sizes) <= S.FEW_TEXTS < max(sizes)
    for k in (3, 10):
        found = S.peers_in_auction(spark.createDataFrame(lots, SCHEMA), k).collect()
        assert {r["id"]: [(p["id"], p["matches"]) for p in r["peers"]] for r in found} == _expected(lots, k)


def test_lots_of_small_groups_are_shuffled_once(spark):
    lots = spark.createDataFrame([r for r in _lots() if r[1] == 2], SCHEMA)
    plan = S.peers_in_auction(lots)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1

"""Sold comparables: the rows a query sees, against a plain loop."""

import datetime
import random

from hammertrail.operators import similar as S

SCHEMA = (
    "id string, brand string, model string, year long, mileage long, hash_id string, scraped_at timestamp, status string, "
    "sold_price long, starting_price long, observations string"
)


def _rows(n):
    rnd = random.Random(5)
    # A blank hash and a hash that reads like the fallback name of a listing are among them.
    hashes = ["a", "b", "c", "d", "", None, "B-GOLF V-2010"]
    day = datetime.datetime(2024, 1, 1)
    return [
        (f"i{i:03}", "B", rnd.choice(["GOLF V", "Golf V", "POLO"]), 2010 + rnd.randrange(5), rnd.randrange(0, 160000, 20000),
         rnd.choice(hashes), day + datetime.timedelta(hours=rnd.randrange(40)), rnd.choice(["sold", "sold", "unsold"]),
         rnd.choice([100, 200, 300]), 50, rnd.choice([None, "RAS", "NON ROULANT"]))
        for i in range(n)
    ]


def _expected(rows, query, n, k):
    brand, model, year, km, mine = query
    word = model.split()[0].upper()
    found = [r for r in rows if r[7] == "sold" and r[1] == brand and word in r[2].upper()]
    found = sorted(sorted(found, key=lambda r: r[0], reverse=True), key=lambda r: r[6], reverse=True)
    seen, listed = [], set()
    for r in [r for r in found if mine is None or (r[5] is not None and r[5] != mine)][:n]:
        key = r[5] or f"{r[1]}-{r[2]}-{r[3]}"
        if key not in listed:
            listed.add(key)
            seen.append(r)
    near = lambda a, b, most: b is not None and abs(a - b) <= most
    flagged = []
    for place, r in enumerate(seen):
        y, m = near(r[3], year, 2), near(r[4], km, 50_000)
        fits = r[10] != "NON ROULANT" and (year is None or y) and (km is None or m)
        flagged.append((-(4 + 2 * y + m), place, r[0], r[8], fits))
    prices = [f[3] for f in flagged if f[4]]
    return len(prices), min(prices, default=None), max(prices, default=None), [(f[2], f[4]) for f in sorted(flagged)[:k]]


def test_rows_seen_by_every_kind_of_query(spark):
    for n, k in ((4, 3), (50, 20)):
        rows = _rows(60)
        queries = [("B", m, y, km, h) for m in ("golf x", "POLO") for y in (2011, None) for km in (40000, None)
                   for h in ("a", "b", "", None, "zz", "B-GOLF V-2010")]
        asked = spark.createDataFrame(queries, "brand string, model string, year long, mileage long, exclude_hash string")
        found = S.similar_sold(asked, spark.createDataFrame(rows, SCHEMA), n, k).collect()
        got = {(r["brand"], r["model"], r["year"], r["mileage"], r["exclude_hash"]):
               (r["n_comparable"], r["min_sold"], r["max_sold"], [(x["id"], x["fits"]) for x in r["results"]]) for r in found}
        assert got == {q: _expected(rows, q, n, k) for q in queries}


def test_queries_do_not_compare_listings(spark):
    """What depends on the list alone is found once for a list, not once for a query."""
    asked = spark.createDataFrame([("B", "GOLF", 2010, 1000, "zz")], "brand string, model string, year long, mileage long, exclude_hash string")
    plan = S.similar_sold(asked, spark.createDataFrame(_rows(30), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan
    top = plan[: plan.index("Join")]
    assert "RLIKE" not in top and "upper(" not in top

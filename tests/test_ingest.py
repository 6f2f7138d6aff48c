"""Readers, writers, and suppression in batch, stream and by hand."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from hammertrail.operators import ingest as N
from hammertrail.sources import readers as R
from hammertrail.sources import writers as W

SF = "/root/testdata/sf0.001"


def test_detail_records_are_rejected_as_a_whole(spark, tmp_path):
    good = {"brand": "FORD", "model": "Puma", "year": 2023, "mileage": 10, "sourceUrl": "u", "photoUrls": ["a"]}
    lines = [good, good | {"year": "2023"}, {k: v for k, v in good.items() if k != "brand"}, good | {"equipment": [1]}]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, lines)) + "\n{oops")
    ok, bad = R.read_snapshots_json(spark, str(tmp_path / "in.json"))
    row = ok.first()
    assert ok.count() == 1 and (row["status"], row["vatRecoverable"], row["photoUrls"]) == ("available", False, ["a"])
    assert sorted(tuple(r["issues"]) for r in bad.collect()) == [("brand",), ("equipment",), ("json",), ("year",)]


def test_list_items_are_skipped_one_by_one(spark, tmp_path):
    items = [{"hashId": "a", "year": "2020", "power": None}, {"year": 2020}, {"hashId": ""}, {"hashId": "b", "mileage": "x"}]
    (tmp_path / "in.json").write_text(json.dumps({"vehicles": items}))
    ok, skipped = R.read_list_items(spark, str(tmp_path / "in.json"))
    assert [(r["hashId"], r["year"], r["status"]) for r in ok.collect()] == [("a", 2020.0, "available")]
    assert skipped.first()[0] == 3


def test_csv_and_reports(spark, tmp_path):
    (tmp_path / "l.csv").write_text(
        'id,brand,model,version,reference,city,mileage,startingPrice,soldPrice,status,sourceUrl\n'
        '1,AUDI,"A4, Avant",v,0123,LORIENT,10,,3500.0,sold,u\n'
    )
    row = R.read_lots_csv(spark, str(tmp_path / "l.csv")).first()
    assert (row["model"], row["reference"], row["startingPrice"], row["soldPrice"]) == ("A4, Avant", "0123", None, 3500.0)
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "abc.txt").write_text("un\ndeux")
    assert tuple(R.read_reports(spark, str(tmp_path / "r")).first()) == ("abc", "un\ndeux")


def _days(table):
    """Names of the data files by day folder."""
    return {d.name: {f.name for f in d.glob("*.parquet")} for d in table.glob("day=*")}


def test_upserts_and_repairs_touch_their_days_only(spark, tmp_path):
    table = tmp_path / "snapshots"

    def rows(*found):
        frame = spark.createDataFrame(list(found), "id long, at string, starting_price long")
        return frame.select("id", F.col("at").cast("timestamp").alias("scraped_at"), "starting_price")

    def stored():
        return sorted((r["id"], str(r["scraped_at"])[:10], r["starting_price"]) for r in W.read_table(spark, str(table)).collect())

    assert W.read_table(spark, str(table)) is None
    W.upsert_snapshots(spark, str(table), rows((1, "2024-01-01", 100), (2, "2024-01-02", 900), (4, "2024-01-04", 7)))
    before = _days(table)
    # One price changes in place, one row is new, one moves off a day that it leaves empty.
    W.upsert_snapshots(spark, str(table), rows((2, "2024-01-02", 950), (3, "2024-01-02", 100), (4, "2024-01-03", 8)))
    want = [(1, "2024-01-01", 100), (2, "2024-01-02", 950), (3, "2024-01-02", 100), (4, "2024-01-03", 8)]
    assert stored() == want
    after = _days(table)
    assert after["day=2024-01-01"] == before["day=2024-01-01"] and after["day=2024-01-02"] != before["day=2024-01-02"]
    W.append_list_snapshots(str(table), rows((5, "2024-01-01", 50), (6, None, 60)))
    want = sorted([*want, (5, "2024-01-01", 50), (6, "None", 60)])
    assert stored() == want and after["day=2024-01-01"] < _days(table)["day=2024-01-01"]
    fix = spark.createDataFrame([(3,), (6,)], "id long")
    W.apply_price_repair(spark, str(table), fix)
    assert stored() == want
    W.apply_price_repair(spark, str(table), fix, dry_run=False)
    assert stored() == [(i, d, None if i in (3, 6) else p) for i, d, p in want]
    (backup,) = tmp_path.glob("snapshots-before-*")
    assert sorted((r["id"], r["starting_price"]) for r in spark.read.parquet(str(backup)).collect()) == [(3, 100), (6, 60)]


def test_documents_are_written_as_json(spark, tmp_path):
    from hammertrail.catalog.history import entities, snapshots
    from hammertrail.plans.history import history_documents

    W.write_documents(history_documents(entities(spark, SF), snapshots(spark, SF)), str(tmp_path / "docs"))
    back = spark.read.json(str(tmp_path / "docs"))
    assert back.count() == entities(spark, SF).count()
    assert back.selectExpr("size(passages) + size(truncated_passages) AS n").filter("n < 1").count() == 0


def test_detail_window_is_extended_by_changes_only(snaps):
    rows = [{"h": 0}, {"h": 0.5, "starting_price": 900}, {"h": 1.4, "starting_price": 900}, {"h": 1.6, "starting_price": 900}, {"h": 3}]
    got = N.detail_merge(snaps(*rows)).orderBy("id").collect()
    assert [(r["action"], r["stored_id"]) for r in got] == [
        ("insert", 1), ("enrich", 1), ("duplicate", 1), ("insert", 4), ("insert", 5)
    ]


def test_list_rows_do_not_extend_the_window(snaps):
    got = N.list_suppression(snaps({"h": 0}, {"h": 5}, {"h": 7}, {"h": 12}, {"h": 13.5})).collect()
    assert sorted(r["id"] for r in got) == [1, 3, 5]


def test_stream_equals_batch(spark):
    from hammertrail.catalog import all_queries

    queries = all_queries()
    got = sorted(map(tuple, queries["stream_detail"](spark, SF).select("snapshot_id", "action", "stored_id").collect()))
    want = sorted(map(tuple, queries["greedy_detail"](spark, SF).select("snapshot_id", "action", "stored_id").collect()))
    assert got == want and len({a for _, a, _ in got}) >= 2


def test_merge_keeps_facts(spark):
    cols = "reference string, starting_price long, live_price long, sold_price long, market_value long, new_price long, photo_urls string, status string"
    names = [c.split()[0] for c in cols.split(", ")]
    old = spark.createDataFrame([("R1", 21300, None, None, None, None, '["a","b"]', "available")], cols)
    new = spark.createDataFrame([("", None, None, 22000, None, None, '["c"]', "sold")], cols)
    pair = old.select(*[F.col(c).alias("o_" + c) for c in names]).join(new.select(*[F.col(c).alias("n_" + c) for c in names]), F.lit(True))
    merged = N.merge_enrichment({c: F.col("o_" + c) for c in names}, {c: F.col("n_" + c) for c in names})
    row = pair.select(*[v.alias(k) for k, v in merged.items()]).first()
    assert (row["reference"], row["starting_price"], row["sold_price"], row["photo_urls"], row["status"]) == ("R1", 21300, 22000, '["a","b"]', "sold")


@pytest.mark.parametrize("run_rows", [1024, 2])
def test_list_suppression_of_long_runs(spark, monkeypatch, run_rows):
    """Runs folded in place and runs followed by links, with equal times and gaps met to the microsecond."""
    monkeypatch.setattr(N, "RUN_ROWS", run_rows)
    rng = random.Random(4)
    hour = 3_600_000_000
    rows = [(k, k % 3, 10**15 + rng.choice([0, 1, rng.randrange(60)]) * hour // 2 + rng.choice([0, 0, 1])) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, vehicle_id long, us long").withColumn("scraped_at", F.timestamp_micros("us"))
    want = set()
    for v in range(3):
        at = None
        for us, row_id in sorted((us, k) for k, e, us in rows if e == v):
            if at is None or us - at > 6 * hour:
                at = us
                want.add((row_id, v))
    assert set(map(tuple, N.list_suppression(df).collect())) == want


def test_a_record_is_parsed_a_fixed_number_of_times(spark):
    from hammertrail.sources import readers

    good, rejects = readers.validate_details(spark.createDataFrame([("{}",)], "value string"))
    for rows in (good.select("status"), rejects):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        # Once in the filter and once for the result, not once for each field.
        assert plan.count("parseJson") <= 4

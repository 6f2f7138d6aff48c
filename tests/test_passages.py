"""Passages, trajectories and evolution on small listings."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from hammertrail.operators import passages as S
from hammertrail.plans.history import History


def passages(frame):
    return [r.asDict() for r in History(frame).passages.orderBy("passage_no").collect()]


def test_one_listing_with_two_dates_is_one_passage(snaps):
    assert len(passages(snaps({"sale_date": "2026-04-13"}, {"sale_date": "2026-04-20"}))) == 1


def test_relist_after_final_status_opens_a_passage(snaps):
    for status in ["sold", "unsold"]:
        rows = passages(snaps({"status": status}, {"sale_date": "2026-05-02"}))
        assert [r["date"] for r in rows] == ["2026-04-13", "2026-05-02"]


def test_linger_after_sale_on_the_same_date_stays(snaps):
    rows = passages(snaps({"status": "sold", "sold_price": 9000}, {"status": "available"}))
    assert len(rows) == 1 and rows[0]["status"] == "sold" and rows[0]["sold_price"] == 9000


def test_live_bids_and_sale_give_the_evolution(snaps):
    run = History(snaps(
        {"status": "auction_live", "live_price": 17900}, {"status": "auction_live", "live_price": 18000},
        {"status": "auction_live", "live_price": 18400}, {"status": "sold", "sold_price": 19800},
    ))
    row = run.evolution.first()
    assert (row["evolution_amount"], row["evolution_direction"]) == (1900, "up")
    assert [r["live_price"] for r in run.lives.orderBy("pos").collect()] == [17900, 18000, 18400]


def test_reserve_drop_is_a_trajectory_with_labels(snaps):
    run = History(snaps({"starting_price": 3900}, {"starting_price": 3900}, {"starting_price": 3500}))
    points = run.price_history.orderBy("pos").collect()
    assert [(p["price"], p["label"]) for p in points] == [(3900, "Mise à prix"), (3500, "Mise à prix ajustée")]


def test_placeholder_is_scrubbed_across_passages_but_kept_without_proof(snaps):
    kept = passages(snaps({"starting_price": 100}, {"starting_price": 100, "live_price": 400}))
    assert kept[0]["starting_price"] == 100
    rows = passages(snaps(
        {"starting_price": 100, "status": "unsold"},
        {"hash_id": "bb", "sale_date": "2026-05-02", "market_value": 21200},
    ))
    assert [r["starting_price"] for r in rows] == [None, None]


def test_wrong_date_is_outvoted_and_ties_take_the_later(snaps):
    good = [{"sale_date": "2026-04-24"}] * 3
    assert passages(snaps(*good, {"sale_date": "2019-08-19"}))[0]["date"] == "2026-04-24"
    assert passages(snaps({"sale_date": "2026-04-24"}, {"sale_date": "2026-04-25"}))[0]["date"] == "2026-04-25"


def test_passages_after_the_last_sale_are_truncated(snaps):
    rows = passages(snaps(
        {"status": "sold", "sold_price": 5000}, {"hash_id": "bb", "sale_date": "2026-04-20"},
        {"hash_id": "cc", "sale_date": "2026-04-13"},
    ))
    assert [r["truncated"] for r in rows] == [False, False, True]


def test_reused_address_is_not_stable(snaps):
    rows = passages(snaps({"status": "sold"}, {"sale_date": "2026-05-02"}))
    assert [(r["open_mode"], r["open_reason"]) for r in rows] == [
        ("local", S.OPEN_REUSED), ("external", S.OPEN_STABLE)
    ]


def test_mode_price_ties_go_to_the_first_seen(snaps):
    rows = passages(snaps(
        {"status": "sold", "starting_price": 700}, {"status": "sold", "starting_price": 900},
        {"status": "sold", "starting_price": 900}, {"status": "sold", "starting_price": 700},
    ))
    assert rows[0]["starting_price"] == 700


def fold(rows):
    """Sequential statement of the relist rule over one chain."""
    closed, seq, out = None, 0, {}
    for r in sorted(rows, key=lambda r: (r["sale_date"] or f"{r['scraped_at']:%Y-%m-%d}", r["scraped_at"], r["id"])):
        if closed is not None and r["sale_date"] is not None and r["sale_date"] > closed:
            closed, seq = None, seq + 1
        if r["status"] in ("sold", "unsold") and r["sale_date"]:
            closed = r["sale_date"]
        out[r["id"]] = seq
    return out


def test_day_cells_equal_the_sequential_rule(spark, snaps):
    rng = random.Random(7)
    rows = []
    for _ in range(600):
        day = rng.choice([None, 9, 10, 11, 12, 13, 14])
        rows.append({
            "vehicle_id": rng.randrange(12), "status": rng.choice(["available", "sold", "unsold", "removed"]),
            "sale_date": day and f"2026-04-{day:02d}", "h": rng.randrange(120),
        })
    frame = snaps(*rows)
    got = {r["id"]: r["seq"] for r in S.sessionise(frame).select("id", "seq").collect()}
    want = {}
    data = [r.asDict() for r in frame.collect()]
    for entity in {r["vehicle_id"] for r in data}:
        want |= fold([r for r in data if r["vehicle_id"] == entity])
    assert got == want


def test_event_is_kept_only_when_a_field_moves(snaps):
    run = History(snaps({"starting_price": 900}, {"starting_price": 900}, {"starting_price": 800}, {"status": "removed", "starting_price": 800}))
    assert [r["id"] for r in run.events.orderBy("id").collect()] == [1, 3, 4]


def test_current_passage_needs_place_date_and_known_details(spark):
    frame = spark.createDataFrame(
        [("PARIS", "2026-04-13", None, 4, "PARIS", "2026-04-13", "Z", 4), ("PARIS", "2026-04-13", "Y", 4, "PARIS", "2026-04-13", "Z", 4),
         ("LYON", "2026-04-13", None, None, "PARIS", "2026-04-13", None, None)],
        "city string, date string, center string, lot_number int, c string, d string, z string, n int",
    ).withColumn("t", F.lit(datetime.datetime(2026, 4, 1)))
    hit = S.is_current(
        {c: F.col(c) for c in ["city", "date", "center", "lot_number"]},
        {"city": F.col("c"), "sale_date": F.col("d"), "center": F.col("z"), "lot_number": F.col("n"), "scraped_at": F.col("t")},
    )
    assert [r[0] for r in frame.select(hit).collect()] == [True, False, False]


def test_documents_nest_passages_and_points(spark, snaps):
    from hammertrail.plans.history import history_documents

    log = snaps({"starting_price": 900}, {"status": "sold", "sold_price": 1500}, {"sale_date": "2026-05-02"}).withColumn(
        "reference", F.lit(None).cast("string")
    )
    entities = spark.createDataFrame([(1, None, "aa", "FORD", "Puma", "", 2023)], "id long, reference string, hash_id string, brand string, model string, version string, year int")
    doc = history_documents(entities, log).first()
    assert len(doc["passages"]) == 1 and len(doc["truncated_passages"]) == 1
    assert [p["price"] for p in doc["price_history"]] == [900, 1500]
    assert doc["evolution"]["evolution_amount"] == 600


def test_summary_needs_no_facts_of_pages(spark, snaps):
    from hammertrail.plans.history import history_summary

    log = snaps(
        {"h": 1, "starting_price": 900}, {"h": 30, "status": "unsold"}, {"h": 50, "sale_date": "2026-04-20", "starting_price": 800},
        {"h": 60, "sale_date": "2026-04-20", "status": "sold", "sold_price": 950}, {"h": 90, "sale_date": "2026-05-02"},
    ).withColumn("reference", F.lit("R1"))
    entities = spark.createDataFrame([(1, "R1", "aa", "FORD", "Puma", "ST", 2023)], "id long, reference string, hash_id string, brand string, model string, version string, year long")
    run = History(log)
    assert run.priced.exceptAll(run.passages.select(*run.priced.columns)).isEmpty() and run.priced.count() == run.passages.count()
    whole = history_summary(entities, log)
    assert [tuple(r)[6:10] for r in whole.collect()] == [(2, 1, 1, 1)]
    bare = history_summary(entities, log.select(*S.PRICED))
    assert bare.collect() == whole.collect()

"""Two batches of records: those of one batch see each other, ids stay apart, sightings move."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from hammertrail.plans import ingest as G

NOW = datetime.datetime(2026, 4, 10, 10)
CAR = {"brand": "FORD", "model": "Puma 1.0", "version": "Flexifuel 125 ch ST-Line X", "year": 2023, "color": "Gris", "fuel": "FH",
       "transmission": "", "engine_size": 999, "power": 125, "fiscal_power": None}
MARKS = {"technical_check_url": None, "condition_image_url": None, "photo_hash": None}
KINDS = {"year": "int", "engine_size": "int", "power": "int", "fiscal_power": "int", "mileage": "long", "id": "long", "vehicle_id": "long"}
SNAP = ["status", "city", "starting_price", "live_price", "sold_price", "market_value", "new_price"]
STORED = {"id": None, "reference": None, "hash_id": None, **CAR, **{"l_" + c: None for c in [*list(CAR)[4:], *MARKS, "mileage"]}, "first_seen_at": None, "last_seen_at": None}


def kind(name):
    if name.endswith("_at"):
        return "timestamp"
    return "long" if name.endswith("_price") or name == "market_value" else KINDS.get(name.removeprefix("l_"), "string")


def frame(spark, names, rows):
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kind(n)}" for n in names))


def record(k, at, **change):
    row = {"id": k, "reference": None, "hash_id": None, **CAR, "mileage": 1000 * k * k, **MARKS, "scraped_at": NOW + datetime.timedelta(days=at)}
    return row | dict.fromkeys(SNAP) | {"status": "available", "city": "PARIS"} | change


def test_records_of_two_batches(spark):
    old = STORED | CAR | {"id": 40, "hash_id": "h40", "reference": "R40", "l_mileage": 500_000, "first_seen_at": NOW, "last_seen_at": NOW}
    entities = frame(spark, list(STORED), [old])
    names = ["id", "vehicle_id", "hash_id", "scraped_at", *SNAP]
    snap = frame(spark, names, [dict.fromkeys(names) | {"id": 1, "vehicle_id": 44, "scraped_at": NOW}])
    watch = spark.createDataFrame([], "id long, vehicle_id long, notes string")
    first = [
        record(101, 1, hash_id="ha", model="Kuga"), record(102, 1, hash_id="ha", reference="R7", model="Kuga"),
        record(103, 1, reference="R7", model="Fiesta"), record(104, 1, hash_id="hb", mileage=50_000),
        record(105, 1, hash_id="hc", mileage=50_100), record(106, 2, hash_id="h40", model="Focus"), record(107, 1, model="Mondeo"),
    ]
    made = G.ingest(frame(spark, list(first[0]), first), entities, snap, watch)
    after = {r.id: r for r in made["entities"].collect()}
    assert sorted(after) == [40, 45, 46, 47]
    assert after[40].last_seen_at == NOW + datetime.timedelta(days=2) and after[40].first_seen_at == NOW
    assert after[45].reference == "R7" and after[46].hash_id in ("hb", "hc") and after[45].first_seen_at == NOW + datetime.timedelta(days=1)

    log = snap.unionByName(made["snapshots"].select(*[F.col(c) for c in names]))
    second = [record(201, 3, hash_id=after[46].hash_id, mileage=50_200), record(202, 3, reference="R7", model="Kuga"), record(203, 3, model="Ka")]
    again = G.ingest(frame(spark, list(second[0]), second), made["entities"], log, watch)
    owners = {r.id: r.vehicle_id for r in again["resolution"].collect()}
    assert (owners[201], owners[202], owners[203]) == (46, 45, None)
    later = {r.id: r for r in again["entities"].collect()}
    assert sorted(later) == [40, 45, 46, 47, 48]
    assert later[45].last_seen_at == later[48].last_seen_at == NOW + datetime.timedelta(days=3)

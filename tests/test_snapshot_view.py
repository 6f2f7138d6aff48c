"""Identities with the same snapshots share one run."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hammertrail.operators import lookups as L
from hammertrail.plans import history as H


@pytest.fixture()
def snap(snaps):
    rows = [
        {"vehicle_id": v, "hash_id": f"h{v}{i % 3}", "lot_number": i % 4, "sale_date": f"2026-04-{10 + i % 3}"} for v in (1, 2, 3) for i in range(12)
    ]
    # The reference of lot 0 is its entity's own, the one of lot 1 is shared by entities 1 and 2, others have none.
    lot, vehicle = F.col("lot_number"), F.col("vehicle_id")
    reference = F.when(lot == 0, F.concat(F.lit("R"), vehicle.cast("string"))).when((lot == 1) & (vehicle < 3), F.lit("shared"))
    extra = {"reference": reference, "scraped_day": F.date_format("scraped_at", "yyyy-MM-dd"), "photo_urls": F.lit("[]"), "has_screenshot": F.lit(False)}
    return snaps(*rows).withColumns(extra)


def test_own_marks_add_no_run(snap, monkeypatch):
    seen, union = [], L.identity_union

    def counted(entities, rows, *more):
        found = union(entities, rows, *more)
        seen.append(found.count())
        return found

    monkeypatch.setattr(L, "identity_union", counted)
    placed = H.snapshot_view(snap)
    # One run of 12 for each entity, and runs of 12 and 3 foreign rows for entities 1 and 2 under the shared reference.
    assert seen == [3 * 12 + 2 * 15]
    assert placed.count() == 36


def test_same_places_as_runs_of_every_identity(snap):
    own = ["vehicle_id", "reference", "hash_id"]
    key = F.to_json(F.struct(*own))
    combos = snap.select(*own).distinct().select(key.alias("id"), F.col("vehicle_id").alias("_vehicle"), "reference", "hash_id")
    run = H.History(L.identity_union(combos, snap), "entity_id")
    every = L.locate_passage(run.chained, run.passages, "entity_id").filter(F.col("entity_id") == key)
    places = ["passage_no", "total_passages"]
    expected = sorted(map(tuple, every.select("id", *places).collect()))
    assert sorted(map(tuple, H.snapshot_view(snap).select("snapshot_id", *places).collect())) == expected
    assert len(expected) == 36


def test_places_need_no_facts_of_passages(snap, monkeypatch):
    from hammertrail.operators import passages as S

    chained = S.sessionise(snap)
    cols = ["vehicle_id", "bucket", "seq", "passage_no"]
    expected = sorted(map(tuple, S.build_passages(chained).select(*cols).collect()))
    assert sorted(map(tuple, S.passage_numbers(chained).select(*cols).collect())) == expected

    def build(*_):
        raise AssertionError("all facts of the passages are shuffled and written")

    monkeypatch.setattr(S, "build_passages", build)
    assert H.snapshot_view(snap).count() == 36

"""Streams over a table of many files whose order is not that of the events."""

from __future__ import annotations

import os
import shutil

import pyarrow.parquet as pq
import pytest

from hammertrail.catalog import all_queries, streams
from hammertrail.streaming import jobs as J
from hammertrail.streaming import processors as C
from hammertrail.streaming.late import healed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_files(tmp_path_factory):
    """The same tables, the events in 120 files of which the first ones hold the latest events."""
    made = tmp_path_factory.mktemp("many")
    for name in os.listdir(SF):
        if name != "events.parquet":
            shutil.copyfile(f"{SF}/{name}", made / name)
    events = pq.read_table(f"{SF}/events.parquet").sort_by([("ts", "descending")])
    (made / "events.parquet").mkdir()
    for k in range(120):
        path = made / "events.parquet" / f"part-{k:03d}.parquet"
        first, end = k * len(events) // 120, (k + 1) * len(events) // 120
        pq.write_table(events.slice(first, end - first), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(made)


@pytest.mark.parametrize("name", ["stream_list", "stream_detail", "stream_passages", "stream_alerts", "stream_activity", "stream_sliding"])
def test_number_and_order_of_files_do_not_matter(spark, many_files, name):
    """Two micro-batches, the later events first."""
    query = all_queries()[name]
    want, got = (sorted(map(str, query(spark, d).collect())) for d in (SF, many_files))
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", ["list_moves", "detail_actions", "passage_numbers"])
@pytest.mark.parametrize("per_trigger, late", [(10, "3650 days"), (40, "1 day")])
def test_many_micro_batches(spark, many_files, name, per_trigger, late):
    """Twelve micro-batches with no row late, and three of which nearly all rows are behind the watermark."""
    query = getattr(streams, name)
    want = sorted(map(str, query(spark, SF, late="3650 days").collect()))
    got = sorted(map(str, query(spark, many_files, per_trigger=per_trigger, late=late).collect()))
    assert got == want


def test_rows_behind_the_watermark_are_missing_until_healed(spark, many_files):
    found = streams._folded(spark, many_files, "list", C.list_rows, C.list_stream, 40, "1 day")
    log = streams.snapshots(spark, many_files)
    assert 0 < found.count() < log.count()
    assert healed(found, log, ["vehicle_id"], streams._moves).count() == log.count()


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Half of the files, then the rest in a new run that finds rows held and rows folded by the first."""
    events = pq.read_table(f"{SF}/events.parquet").sort_by([("ts", "ascending")])
    (tmp_path / "events.parquet").mkdir()
    def put(first, end):
        for k in range(first, end):
            a, b = k * len(events) // 8, (k + 1) * len(events) // 8
            pq.write_table(events.slice(a, b - a), tmp_path / "events.parquet" / f"part-{k}.parquet")
    put(0, 4)
    where = J.folder(spark, "restart")
    rows = C.list_rows(streams._stream(spark, str(tmp_path), "fx_snapshots", 1))
    fold = C.list_stream(J.with_end(rows, where), late="12 hours")
    early = J.drain(fold, "restart", where=where).count()
    put(4, 8)
    got = J.drain(fold, "restart", where=where, ends=rows)
    want = streams.list_moves(spark, SF, late="3650 days").drop("id")
    assert 0 < early < got.count() == len(events)
    assert sorted(map(str, got.filter("stored").drop("id").collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("shards", [1, 2048])
def test_keys_share_shards(spark, monkeypatch, shards):
    """Many keys are folded by one call each for its shard; a missing key does not round the large ids of others."""
    monkeypatch.setattr(C, "SHARDS", shards)
    large = 2**60 + 1
    rows = spark.range(600).selectExpr(
        "id", f"CASE WHEN id % 7 = 0 THEN NULL ELSE {large} + id % 50 END AS vehicle_id", "concat('h', id % 40) AS hash_id", "'PARIS' AS city",
        "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, id * 37 % 101) AS scraped_at", "cast(id * 31 % 90 + 1 AS bigint) AS starting_price",
        "CASE WHEN id % 3 = 0 THEN 'sold' ELSE 'available' END AS status", "CASE WHEN id % 5 > 0 THEN concat('2024-01-0', 1 + id * 7 % 6) END AS sale_date",
    )
    where = J.folder(spark, "shards")
    rows.write.parquet(f"{where}/in")
    for make, fold in ((C.list_rows, C.list_stream), (C.passage_rows, C.passage_stream)):
        made = make(spark.readStream.schema(rows.schema).parquet(f"{where}/in"))
        base = J.folder(spark, "shards")
        got = J.drain(fold(J.with_end(made, base)), "shards", where=base, ends=made)
        known = rows.filter("vehicle_id IS NOT NULL")
        want = streams._moves(known) if fold is C.list_stream else streams.passages.sessionise(known)
        got = got.filter("vehicle_id IS NOT NULL")
        columns = [c for c in ("vehicle_id", "bucket", "id", "seq", "price_changed") if c in got.columns]
        assert got.count() > 0
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))

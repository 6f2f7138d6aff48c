"""The chained snapshots are worked out once for a run that reads them several times."""

from hammertrail.plans.history import History


def test_several_readers_share_one_written_chain(spark, snaps):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    log = snaps({"starting_price": 100}, {"starting_price": 200}, {"status": "sold", "sold_price": 250}, {"sale_date": "2026-05-01"})
    run = History(log)
    assert "Window" in plan(run.chained)
    for part in (run.price_history, run.events):
        assert part.count() > 0
        assert "Window" not in plan(run.chained)
    alone = History(log)
    assert sorted(map(str, alone.passages.collect())) == sorted(map(str, run.passages.collect()))
    assert "Window" in plan(alone.chained)

"""Expected results of the streaming queries: those of the batch operators."""

from __future__ import annotations

from oracles.base import chain_ctes, view, with_ctes
from oracles.ingest import DETAIL
from oracles.tracking import DELTA

SNAP = view("fx_snapshots")
KEPT = [SNAP, ("sq", "SELECT id, vehicle_id, scraped_at, starting_price, row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at, id) AS rn FROM fx_snapshots"),
    ("g", """
SELECT vehicle_id, rn, id, scraped_at AS anchor, starting_price, scraped_at, true AS kept FROM sq WHERE rn = 1
UNION ALL SELECT s.vehicle_id, s.rn, s.id, CASE WHEN s.scraped_at - INTERVAL 6 HOUR > g.anchor THEN s.scraped_at ELSE g.anchor END, s.starting_price, s.scraped_at,
  s.scraped_at - INTERVAL 6 HOUR > g.anchor FROM g JOIN sq s ON s.vehicle_id = g.vehicle_id AND s.rn = g.rn + 1"""), ("mv", """
SELECT id AS snapshot_id, vehicle_id, CASE WHEN starting_price <> 0 AND p <> 0 AND starting_price <> p THEN starting_price - p END AS price_changed FROM (
  SELECT *, lag(starting_price) OVER (PARTITION BY vehicle_id ORDER BY rn) AS p FROM g WHERE kept) x""")]


def recursive(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    return with_ctes(KEPT + (extra or []), body).replace("WITH ", "WITH RECURSIVE ", 1)


SQL = {
    "stream_detail": DETAIL,
    "stream_list": recursive("SELECT * FROM mv"),
    "stream_alerts": recursive("""
SELECT mv.vehicle_id, snapshot_id, price_changed, CASE WHEN price_changed < 0 THEN 'price_drop' ELSE 'price_up' END AS type
FROM mv JOIN fx_watchlist w ON w.vehicle_id = mv.vehicle_id WHERE price_changed IS NOT NULL AND alert_on_price""", [view("fx_watchlist")]),
    "stream_passages": with_ctes([SNAP] + chain_ctes(), "SELECT vehicle_id, bucket, id AS snapshot_id, seq FROM ch"),
    "stream_visits": with_ctes([view("fx_visits")], """
SELECT coalesce('vehicle:' || vehicle_id, 'hash:' || hash_id, 'ref:' || reference) AS visit_key, count(*) AS visit_count, epoch_us(max(visited_at)) AS last_visited_at FROM fx_visits GROUP BY 1"""),
    "stream_activity": with_ctes([SNAP], """
SELECT strftime(scraped_at, '%Y-%m-%d') AS start, status, count(*) AS n, count(starting_price) AS n_priced, CAST(sum(starting_price) AS BIGINT) AS price_sum FROM fx_snapshots GROUP BY 1, 2"""),
    "stream_sliding": with_ctes([SNAP], """
SELECT epoch_us(w) AS start, status, count(*) AS n FROM (
  SELECT status, unnest([time_bucket(INTERVAL 6 HOUR, scraped_at, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, scraped_at, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS w FROM fx_snapshots) x GROUP BY 1, 2"""),
    "stream_vanished": with_ctes(DELTA, "SELECT * FROM gone"),
}

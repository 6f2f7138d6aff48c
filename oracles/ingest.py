"""Expected results of the ingest queries."""

from __future__ import annotations

from oracles.base import view, with_ctes

SNAP = view("fx_snapshots")
OLD = [SNAP, ("bt", "SELECT * FROM fx_snapshots QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at DESC, id DESC) = 1"),
    ("od", """
SELECT s.* FROM fx_snapshots s JOIN bt ON bt.vehicle_id = s.vehicle_id AND s.scraped_at < bt.scraped_at AND s.scraped_at >= bt.scraped_at - INTERVAL 12 HOUR
QUALIFY row_number() OVER (PARTITION BY s.vehicle_id ORDER BY s.scraped_at DESC, s.id DESC) = 1"""), ("jn", """
SELECT n.vehicle_id, n.id, o.id AS oid, n.starting_price AS np, o.starting_price AS op, n.live_price AS nl, o.live_price AS ol, n.sold_price AS ns, o.sold_price AS os,
  n.market_value AS nm, o.market_value AS om, n.sale_date AS nd, o.sale_date AS od, n.center AS nc, o.center AS oc, n.observations AS nobs, o.observations AS oobs,
  n.photo_urls AS nph, o.photo_urls AS oph, n.status AS nst, o.status AS ost,
  CASE WHEN json_valid(n.photo_urls) THEN json_array_length(n.photo_urls) ELSE 0 END AS nn, CASE WHEN json_valid(o.photo_urls) THEN json_array_length(o.photo_urls) ELSE 0 END AS onn,
  CASE WHEN o.id IS NULL THEN 'insert' WHEN n.starting_price IS DISTINCT FROM o.starting_price OR n.market_value IS DISTINCT FROM o.market_value
    OR n.live_price IS DISTINCT FROM o.live_price OR n.city <> o.city OR n.center IS DISTINCT FROM o.center OR n.sale_date IS DISTINCT FROM o.sale_date
    OR n.sale_time IS DISTINCT FROM o.sale_time OR n.technical_check_url IS DISTINCT FROM o.technical_check_url OR n.observations IS DISTINCT FROM o.observations
    OR n.status <> o.status OR n.sold_price IS DISTINCT FROM o.sold_price OR (o.reference IS NULL AND n.reference IS NOT NULL) OR (o.hash_id IS NULL AND n.hash_id IS NOT NULL)
    OR CASE WHEN json_valid(n.photo_urls) THEN json_array_length(n.photo_urls) ELSE 0 END > CASE WHEN json_valid(o.photo_urls) THEN json_array_length(o.photo_urls) ELSE 0 END
  THEN 'enrich' ELSE 'duplicate' END AS action FROM bt n LEFT JOIN od o ON o.vehicle_id = n.vehicle_id"""), ("ms", """
SELECT *, coalesce(coalesce(nl, ol), 0) >= 500 OR coalesce(ns, 0) >= 500 OR coalesce(coalesce(nm, om), 0) >= 1000 AS bad,
  coalesce(nl, 0) >= 500 OR coalesce(ns, 0) >= 500 OR coalesce(nm, 0) >= 1000 AS nbad FROM jn""")]


def _fake(price: str, live: str, sold: str, market: str, new: str) -> str:
    return f"coalesce({price}, 0) = 100 AND (greatest(coalesce({live}, 0), coalesce({sold}, 0)) >= 500 OR greatest(coalesce({market}, 0), coalesce({new}, 0)) >= 1000)"


OWN = _fake("starting_price", "live_price", "sold_price", "market_value", "new_price")
SIGNALS = ("coalesce(live_price, o.live_price)", "sold_price", "coalesce(market_value, o.market_value)", "coalesce(new_price, o.new_price)")
BEST = f"CASE WHEN starting_price IS NULL OR ({_fake('starting_price', *SIGNALS)}) THEN o.starting_price ELSE starting_price END"
KNOWN = ["market_value", "new_price", "live_price", "sold_price", "sale_date", "sale_time", "center"]
TEXTS = ["reference", "hash_id", "technical_check_url", "observations"]
COMPARED = ["starting_price", *KNOWN, "city", "technical_check_url", "observations", "status"]
FRESH = "{" + f"'starting_price': CASE WHEN NOT ({OWN}) THEN starting_price END, " + ", ".join(f"'{c}': {c}" for c in [*KNOWN, *TEXTS, "city", "status"]) + "}"
MERGED = "{" + f"'starting_price': CASE WHEN NOT ({_fake('(' + BEST + ')', *SIGNALS)}) THEN {BEST} END, " + ", ".join(
    [f"'{c}': coalesce({c}, o.{c})" for c in KNOWN] + [f"'{c}': coalesce(nullif({c}, ''), o.{c})" for c in TEXTS] + [f"'{c}': {c}" for c in ("city", "status")]) + "}"
DIFFERS = " OR ".join([f"o.{c} IS DISTINCT FROM {c}" for c in COMPARED] + [f"(coalesce(o.{c}, '') = '' AND coalesce({c}, '') <> '')" for c in ("reference", "hash_id")])
DETAIL = with_ctes([SNAP, ("sq", "SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at, id) AS rn FROM fx_snapshots"),
    ("g", f"""
SELECT vehicle_id, rn, id, 'insert' AS action, id AS stored_id, scraped_at AS seen, {FRESH} AS o FROM sq WHERE rn = 1
UNION ALL
SELECT vehicle_id, rn, id, act, CASE act WHEN 'insert' THEN id ELSE stored_id END, CASE act WHEN 'duplicate' THEN seen ELSE scraped_at END,
  CASE act WHEN 'insert' THEN {FRESH} WHEN 'duplicate' THEN o ELSE {MERGED} END
FROM (SELECT s.*, g.o, g.stored_id, g.seen, CASE WHEN s.scraped_at - INTERVAL 6 HOUR > g.seen THEN 'insert' WHEN {DIFFERS.replace(" DISTINCT FROM ", " DISTINCT FROM s.").replace("coalesce(reference", "coalesce(s.reference").replace("coalesce(hash_id", "coalesce(s.hash_id")}
  THEN 'enrich' ELSE 'duplicate' END AS act FROM g JOIN sq s ON s.vehicle_id = g.vehicle_id AND s.rn = g.rn + 1) x""")],
    "SELECT id AS snapshot_id, vehicle_id, action, stored_id FROM g").replace("WITH ", "WITH RECURSIVE ", 1)

SQL = {
    "greedy_detail": DETAIL,
    "greedy_list": with_ctes([SNAP, ("sq", "SELECT id, vehicle_id, scraped_at, row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at, id) AS rn FROM fx_snapshots"),
        ("g", """
SELECT vehicle_id, rn, id, scraped_at AS anchor, true AS kept FROM sq WHERE rn = 1
UNION ALL SELECT s.vehicle_id, s.rn, s.id, CASE WHEN s.scraped_at - INTERVAL 6 HOUR > g.anchor THEN s.scraped_at ELSE g.anchor END, s.scraped_at - INTERVAL 6 HOUR > g.anchor
FROM g JOIN sq s ON s.vehicle_id = g.vehicle_id AND s.rn = g.rn + 1""")], "SELECT id AS snapshot_id, vehicle_id FROM g WHERE kept").replace("WITH ", "WITH RECURSIVE ", 1),
    "ingest_batch": with_ctes(OLD, """
SELECT vehicle_id, action, CASE WHEN action = 'insert' THEN id ELSE oid END AS snapshot_id,
  CASE action WHEN 'insert' THEN CASE WHEN NOT (nbad AND np = 100) THEN np END WHEN 'duplicate' THEN op
    ELSE CASE WHEN NOT (bad AND coalesce(CASE WHEN NOT (bad AND np = 100) THEN np END, op) = 100) THEN coalesce(CASE WHEN NOT (bad AND np = 100) THEN np END, op) END END AS starting_price,
  CASE action WHEN 'insert' THEN nl WHEN 'duplicate' THEN ol ELSE coalesce(nl, ol) END AS live_price,
  CASE action WHEN 'insert' THEN ns WHEN 'duplicate' THEN os ELSE coalesce(ns, os) END AS sold_price,
  CASE action WHEN 'insert' THEN nd WHEN 'duplicate' THEN od ELSE coalesce(nd, od) END AS sale_date,
  CASE action WHEN 'insert' THEN nc WHEN 'duplicate' THEN oc ELSE coalesce(nc, oc) END AS center,
  CASE action WHEN 'insert' THEN nobs WHEN 'duplicate' THEN oobs ELSE coalesce(nobs, oobs) END AS observations,
  CASE action WHEN 'insert' THEN nph WHEN 'duplicate' THEN oph ELSE CASE WHEN onn > nn THEN oph ELSE nph END END AS photo_urls,
  CASE action WHEN 'duplicate' THEN ost ELSE nst END AS status FROM ms"""),
    "detail_json": """
SELECT CASE event_id % 5 WHEN 1 THEN 'brand' WHEN 2 THEN 'mileage' WHEN 3 THEN 'year' WHEN 4 THEN 'json' ELSE 'ok available' END AS issue, count(*) AS n FROM events GROUP BY 1""",
    "list_json": """
SELECT event_id % 5 <> 1 AND event_id % 3 = 0 AS valid, count(*) AS n, CAST(sum(CASE WHEN event_id % 5 <> 1 AND event_id % 3 = 0 THEN user_id END) AS BIGINT) AS mileage FROM events GROUP BY 1""",
}

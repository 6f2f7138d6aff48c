"""Expected results of the history queries."""

from __future__ import annotations

from oracles.base import chain_ctes, identity_ctes, view, with_ctes

BASE = [view("fx_snapshots")] + chain_ctes()
OPEN_REASON = """CASE WHEN reused THEN 'URL réutilisée par un passage ultérieur' ELSE 'URL historique stable' END"""

SQL = {
    "passages": with_ctes(BASE, """
SELECT vehicle_id, passage_no, date, snapshot_id, status, city, center, sale_time, lot_number, observations,
  technical_check_url, starting_price, live_price, sold_price, mileage, n_snapshots FROM pass"""),
    "canonical": with_ctes(BASE, "SELECT vehicle_id, bucket, seq, id AS snapshot_id, status, sold_price FROM canon"),
    "consensus_date": with_ctes(BASE, "SELECT vehicle_id, bucket, seq, date, passage_no FROM pass"),
    "start_trajectory": with_ctes(BASE, "SELECT vehicle_id, bucket, seq, pos, price FROM st"),
    "live_trajectory": with_ctes(BASE, "SELECT vehicle_id, bucket, seq, pos, price FROM lv"),
    "event_compression": with_ctes(BASE + [("ee", """
SELECT *, row_number() OVER w AS rn,
  lag(cp) OVER w AS q1, lag(live_price) OVER w AS q2, lag(sold_price) OVER w AS q3, lag(status) OVER w AS q4,
  lag(sale_date) OVER w AS q5, lag(sale_time) OVER w AS q6, lag(mileage) OVER w AS q7, lag(source_url) OVER w AS q8
FROM cl WINDOW w AS (PARTITION BY vehicle_id, bucket, seq ORDER BY scraped_at, id)""")], """
SELECT ee.vehicle_id, pass.passage_no, ee.id AS snapshot_id, ee.status, cp AS starting_price, ee.live_price, ee.sold_price, ee.mileage,
  CASE WHEN ee.id = pass.snapshot_id AND NOT reused THEN 'external' ELSE 'local' END AS event_mode,
  CASE WHEN ee.id <> pass.snapshot_id THEN 'Snapshot intermédiaire d’un même passage' ELSE """ + OPEN_REASON + """ END AS event_reason
FROM ee JOIN pass USING (vehicle_id, bucket, seq)
WHERE rn = 1 OR cp IS DISTINCT FROM q1 OR ee.live_price IS DISTINCT FROM q2 OR ee.sold_price IS DISTINCT FROM q3
  OR ee.status IS DISTINCT FROM q4 OR ee.sale_date IS DISTINCT FROM q5 OR ee.sale_time IS DISTINCT FROM q6
  OR ee.mileage IS DISTINCT FROM q7 OR ee.source_url IS DISTINCT FROM q8"""),
    "latest_live": with_ctes(BASE, "SELECT vehicle_id, passage_no, live_price FROM pass WHERE live_price IS NOT NULL"),
    "auction_price": with_ctes(BASE, "SELECT vehicle_id, passage_no, presale AS presale_price, mode_price, starting_price FROM pass"),
    "first_known": with_ctes(BASE, """
SELECT p.vehicle_id, passage_no, sale_time, center, lot_number, observations, technical_check_url, p.mileage, f.first_price
FROM pass p LEFT JOIN (SELECT vehicle_id, nullif(first(starting_price ORDER BY scraped_at, id), 0) AS first_price
  FROM fx_snapshots WHERE starting_price IS NOT NULL GROUP BY 1) f USING (vehicle_id)"""),
    "final_sale_cut": with_ctes(BASE, "SELECT vehicle_id, passage_no, date, status, cutoff, truncated FROM pass"),
    "evolution": with_ctes(BASE, """
SELECT vehicle_id, total_passages, sold_count, unsold_count, first_starting_price, last_effective_price,
  last_passage_sold, evolution_amount, evolution_direction FROM evo"""),
    "price_history": with_ctes(BASE, "SELECT vehicle_id, passage_no, kind, pos, date, price, label FROM points"),
    "series_summary": with_ctes(BASE, """
SELECT vehicle_id, count(*) AS n_points, min(price) AS min_price, max(price) AS max_price,
  first(price ORDER BY passage_no, kind, pos) AS first_price, last(price ORDER BY passage_no, kind, pos) AS last_price,
  last(price ORDER BY passage_no, kind, pos) - first(price ORDER BY passage_no, kind, pos) AS diff
FROM points GROUP BY 1 HAVING count(*) >= 2"""),
    "navigation": with_ctes(BASE, f"""
SELECT vehicle_id, passage_no, snapshot_id, NOT reused AS is_stable,
  CASE WHEN reused THEN 'local' ELSE 'external' END AS open_mode, {OPEN_REASON} AS open_reason FROM pass"""),
    "mileage_history": with_ctes(BASE, "SELECT vehicle_id, passage_no, date, mileage FROM kept"),
    "evidence": with_ctes(BASE, """
SELECT vehicle_id, nullif(live,0) AS e_live, nullif(sold,0) AS e_sold, nullif(market,0) AS e_market,
  nullif(neuf,0) AS e_new, disproved FROM ev"""),
    "history_document": with_ctes(identity_ctes() + chain_ctes("idsnap", "entity_id"), """
SELECT e.id AS entity_id, coalesce(e.reference,'') AS reference, coalesce(e.hash_id,'') AS hash_id, brand, model, year,
  n_passages, n_truncated, sold_count, unsold_count, first_starting_price, last_effective_price, last_passage_sold,
  evolution_amount, evolution_direction
FROM ents e JOIN evo ON evo.entity_id = e.id
JOIN (SELECT entity_id, count(*) FILTER (WHERE NOT truncated) AS n_passages, count(*) FILTER (WHERE truncated) AS n_truncated
      FROM pass GROUP BY 1) c ON c.entity_id = e.id"""),
    "identity_union": with_ctes(identity_ctes(), """
SELECT entity_id, count(*) AS n_snapshots, count(*) FILTER (WHERE vehicle_id <> entity_id) AS n_foreign,
  CAST(sum(id) AS BIGINT) AS id_sum FROM idsnap GROUP BY 1"""),
    "cross_auction": with_ctes(identity_ctes(True, True) + chain_ctes("idsnap", "entity_id"), f"""
SELECT entity_id, passage_no, snapshot_id, hash_id, has_screenshot, city, date AS sale_date, sale_time, status,
  starting_price, sold_price, lot_number, mileage, source_url, NOT reused AS is_stable,
  CASE WHEN reused THEN 'local' ELSE 'external' END AS open_mode, {OPEN_REASON} AS open_reason, truncated, f.first_starting_price
FROM pass LEFT JOIN (SELECT entity_id, nullif(first(starting_price ORDER BY scraped_at, id), 0) AS first_starting_price
  FROM idsnap WHERE starting_price IS NOT NULL GROUP BY 1) f USING (entity_id)"""),
    "snapshot_view": with_ctes([view("fx_snapshots"), ("combos", """
SELECT DISTINCT concat_ws('|', vehicle_id, coalesce(reference,''), coalesce(hash_id,'')) AS entity_id,
  vehicle_id AS v, reference AS r, hash_id AS h FROM fx_snapshots"""), ("idsnap", """
SELECT c.entity_id, s.* FROM combos c JOIN (
  SELECT c.entity_id AS eid, s.id AS sid FROM combos c JOIN fx_snapshots s ON s.vehicle_id = c.v
  UNION SELECT c.entity_id, s.id FROM combos c JOIN fx_snapshots s ON s.reference = c.r
  UNION SELECT c.entity_id, s.id FROM combos c JOIN fx_snapshots s ON s.hash_id = c.h) m ON m.eid = c.entity_id
JOIN fx_snapshots s ON s.id = m.sid""")] + chain_ctes("idsnap", "entity_id"), """
SELECT ch.id AS snapshot_id, ch.vehicle_id, passage_no, n AS total_passages, ch.city, ch.center, ch.status, ch.sale_date, ch.sale_time
FROM ch JOIN pass USING (entity_id, bucket, seq) JOIN (SELECT entity_id, count(*) AS n FROM pass GROUP BY 1) t USING (entity_id)
WHERE ch.entity_id = concat_ws('|', ch.vehicle_id, coalesce(ch.reference,''), coalesce(ch.hash_id,''))"""),
}

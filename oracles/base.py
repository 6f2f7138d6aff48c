"""Shared pieces of the expected-result statements.

The statements are written for DuckDB and independently of the Spark plans:
they use plain windows per chain where the plans group by day first.
"""

from __future__ import annotations

from hammertrail.sources.views import view_sql


def with_ctes(ctes: list[tuple[str, str]], body: str) -> str:
    parts = ",\n".join(f"{name} AS (\n{text}\n)" for name, text in ctes)
    return f"WITH {parts}\n{body}"


def view(name: str) -> tuple[str, str]:
    return name, view_sql(name, "duckdb")


def chain_ctes(source: str = "fx_snapshots", entity: str = "vehicle_id") -> list[tuple[str, str]]:
    """From snapshots in ``source`` to passages in ``pass`` and kept ones in ``kept``."""
    e = entity
    return [
        ("k1", f"""
SELECT *, coalesce(nullif(sale_date,''), strftime(scraped_at,'%Y-%m-%d')) AS ord_date,
  CASE WHEN status IN ('sold','unsold') THEN nullif(sale_date,'') END AS term
FROM {source}"""),
        ("k2", """
SELECT *, CASE WHEN nullif(hash_id,'') IS NOT NULL THEN 'hash|' || hash_id
  ELSE 'loc|' || coalesce(nullif(city,''),'unknown') || '|' || ord_date END AS bucket FROM k1"""),
        ("k3", f"""
SELECT *, max(term) OVER (PARTITION BY {e}, bucket ORDER BY ord_date, scraped_at, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t,
  first(scraped_at) OVER (PARTITION BY {e}, bucket ORDER BY scraped_at, id) AS bf_ts,
  first(id) OVER (PARTITION BY {e}, bucket ORDER BY scraped_at, id) AS bf_id FROM k2"""),
        ("k4", "SELECT *, (t IS NOT NULL AND sale_date > t) AS c FROM k3"),
        ("k5", f"""
SELECT *, CASE WHEN c AND row_number() OVER (PARTITION BY {e}, bucket, t, c ORDER BY ord_date, scraped_at, id) = 1
  THEN 1 ELSE 0 END AS b FROM k4"""),
        ("ch", f"""
SELECT *, CAST(sum(b) OVER (PARTITION BY {e}, bucket ORDER BY ord_date, scraped_at, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seq FROM k5"""),
        ("ev", f"""
SELECT {e}, max(live_price) AS live, max(sold_price) AS sold, max(market_value) AS market, max(new_price) AS neuf,
  (coalesce(max(live_price),0) >= 500 OR coalesce(max(sold_price),0) >= 500
   OR coalesce(max(market_value),0) >= 1000 OR coalesce(max(new_price),0) >= 1000) AS disproved
FROM {source} GROUP BY {e}"""),
        ("cl", f"""
SELECT ch.*, ev.disproved, CASE WHEN NOT (ev.disproved AND starting_price = 100) THEN starting_price END AS cp
FROM ch JOIN ev USING ({e})"""),
        ("canon", f"""
SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY {e}, bucket, seq
  ORDER BY (sold_price IS NULL), scraped_at DESC, ord_date, id) = 1"""),
        ("dmode", f"""
SELECT {e}, bucket, seq, sale_date AS mode_date FROM (
  SELECT {e}, bucket, seq, sale_date, count(*) AS n FROM ch WHERE nullif(sale_date,'') IS NOT NULL GROUP BY ALL) x
QUALIFY row_number() OVER (PARTITION BY {e}, bucket, seq ORDER BY n DESC, sale_date DESC) = 1"""),
        ("pmode", f"""
SELECT {e}, bucket, seq, cp AS mode_price FROM (
  SELECT {e}, bucket, seq, cp, count(*) AS n, min(rn) AS seen_at FROM (
    SELECT *, row_number() OVER (PARTITION BY {e}, bucket, seq ORDER BY ord_date, scraped_at, id) AS rn FROM cl) y
  WHERE cp IS NOT NULL GROUP BY {e}, bucket, seq, cp) x
QUALIFY row_number() OVER (PARTITION BY {e}, bucket, seq ORDER BY n DESC, seen_at) = 1"""),
        ("agg", f"""
SELECT {e}, bucket, seq, min(bf_ts) AS bf_ts, min(bf_id) AS bf_id, count(*) AS n_snapshots,
  last(cp ORDER BY scraped_at, id) FILTER (WHERE status IN ('available','auction_live') AND cp IS NOT NULL) AS presale,
  last(live_price ORDER BY scraped_at, id) FILTER (WHERE live_price > 0) AS last_live,
  first(live_price ORDER BY scraped_at, id) FILTER (WHERE live_price > 0) AS first_live,
  first(sale_time ORDER BY ord_date, scraped_at, id) FILTER (WHERE sale_time IS NOT NULL) AS f_time,
  first(center ORDER BY ord_date, scraped_at, id) FILTER (WHERE center IS NOT NULL) AS f_center,
  first(lot_number ORDER BY ord_date, scraped_at, id) FILTER (WHERE lot_number IS NOT NULL) AS f_lot,
  first(observations ORDER BY ord_date, scraped_at, id) FILTER (WHERE observations IS NOT NULL) AS f_obs,
  first(technical_check_url ORDER BY ord_date, scraped_at, id) FILTER (WHERE technical_check_url IS NOT NULL) AS f_ct,
  first(mileage ORDER BY ord_date, scraped_at, id) FILTER (WHERE mileage > 0) AS f_km
FROM cl GROUP BY {e}, bucket, seq"""),
        ("st0", f"""
SELECT *, lag(cp) OVER (PARTITION BY {e}, bucket, seq ORDER BY scraped_at, id) AS prev
FROM cl WHERE status IN ('available','auction_live') AND cp IS NOT NULL"""),
        ("st", f"""
SELECT {e}, bucket, seq, cp AS price, row_number() OVER (PARTITION BY {e}, bucket, seq ORDER BY scraped_at, id) AS pos
FROM st0 WHERE prev IS NULL OR prev <> cp"""),
        ("lv0", f"""
SELECT *, lag(live_price) OVER (PARTITION BY {e}, bucket, seq ORDER BY scraped_at, id) AS prev
FROM ch WHERE live_price > 0"""),
        ("lv", f"""
SELECT {e}, bucket, seq, live_price AS price, row_number() OVER (PARTITION BY {e}, bucket, seq ORDER BY scraped_at, id) AS pos
FROM lv0 WHERE prev IS NULL OR prev <> live_price"""),
        ("stn", f"SELECT {e}, bucket, seq, count(*) AS n_start, max(CASE WHEN pos = 1 THEN price END) AS head FROM st GROUP BY ALL"),
        ("lvn", f"SELECT {e}, bucket, seq, count(*) AS n_live FROM lv GROUP BY ALL"),
        ("pass0", f"""
SELECT c.{e}, c.bucket, c.seq, coalesce(d.mode_date, c.ord_date) AS date, c.id AS snapshot_id, c.status, c.city,
  c.source_url, c.hash_id, c.has_screenshot, coalesce(c.sale_time, a.f_time) AS sale_time, coalesce(c.center, a.f_center) AS center,
  coalesce(c.lot_number, a.f_lot) AS lot_number, coalesce(c.observations, a.f_obs) AS observations,
  coalesce(c.technical_check_url, a.f_ct) AS technical_check_url,
  coalesce(a.presale, m.mode_price) AS starting_price, a.presale, m.mode_price, a.last_live AS live_price, a.first_live,
  c.sold_price, coalesce(nullif(c.mileage,0), a.f_km, 0) AS mileage, a.n_snapshots, a.bf_ts, a.bf_id,
  coalesce(n_start,0) AS n_start, head, coalesce(n_live,0) AS n_live
FROM canon c JOIN agg a USING ({e}, bucket, seq) LEFT JOIN dmode d USING ({e}, bucket, seq)
LEFT JOIN pmode m USING ({e}, bucket, seq) LEFT JOIN stn USING ({e}, bucket, seq) LEFT JOIN lvn USING ({e}, bucket, seq)"""),
        ("pass1", f"""
SELECT *, row_number() OVER (PARTITION BY {e} ORDER BY date, bf_ts, bf_id, seq) AS passage_no,
  max(CASE WHEN status = 'sold' THEN date END) OVER (PARTITION BY {e}) AS cutoff,
  regexp_replace(lower(regexp_replace(source_url, '^https?://(www[.])?', '')), '/+$', '') AS nurl FROM pass0"""),
        ("pass", f"""
SELECT *, coalesce(date > cutoff, false) AS truncated,
  (coalesce(max(CASE WHEN hash_id IS NOT NULL THEN passage_no END) OVER (PARTITION BY {e}, hash_id) > passage_no AND hash_id IS NOT NULL, false)
   OR max(passage_no) OVER (PARTITION BY {e}, nurl) > passage_no) AS reused FROM pass1"""),
        ("kept", "SELECT * FROM pass WHERE NOT truncated"),
        ("evo0", f"""
SELECT {e}, count(*) AS total_passages, count(*) FILTER (WHERE status='sold') AS sold_count,
  count(*) FILTER (WHERE status='unsold') AS unsold_count,
  coalesce(first(CASE WHEN n_start > 1 THEN head END ORDER BY passage_no),
           first(starting_price ORDER BY passage_no) FILTER (WHERE starting_price IS NOT NULL)) AS first_starting_price,
  first(first_live ORDER BY passage_no) FILTER (WHERE first_live IS NOT NULL) AS first_live,
  last(coalesce(sold_price, live_price, starting_price) ORDER BY passage_no) AS last_effective_price,
  last(status = 'sold' AND sold_price IS NOT NULL ORDER BY passage_no) AS last_passage_sold
FROM kept GROUP BY {e}"""),
        ("evo1", "SELECT *, last_effective_price - coalesce(first_starting_price, first_live) AS evolution_amount FROM evo0"),
        ("evo", """
SELECT *, CASE WHEN evolution_amount > 0 THEN 'up' WHEN evolution_amount < 0 THEN 'down'
  WHEN evolution_amount = 0 THEN 'stable' ELSE 'unknown' END AS evolution_direction FROM evo1"""),
        ("tot", f"SELECT {e}, count(*) AS total FROM kept GROUP BY {e}"),
        ("points", f"""
SELECT {e}, passage_no, 1 AS kind, st.pos, date, st.price, CASE WHEN total > 1
    THEN 'MAP P' || passage_no || CASE WHEN st.pos > 1 THEN ' (ajusté)' ELSE '' END
    WHEN st.pos > 1 THEN 'Mise à prix ajustée' ELSE 'Mise à prix' END AS label
FROM kept JOIN tot USING ({e}) JOIN st USING ({e}, bucket, seq) WHERE n_start > 1
UNION ALL
SELECT {e}, passage_no, 1, 1, date, starting_price, CASE WHEN total > 1 THEN 'MAP P' || passage_no ELSE 'Mise à prix' END
FROM kept JOIN tot USING ({e}) WHERE n_start <= 1 AND starting_price IS NOT NULL
UNION ALL
SELECT {e}, passage_no, 2, lv.pos, date, lv.price, CASE WHEN total > 1 THEN 'Enchère P' || passage_no ELSE 'Enchère en cours' END
  || CASE WHEN n_live > 1 THEN ' #' || lv.pos ELSE '' END
FROM kept JOIN tot USING ({e}) JOIN lv USING ({e}, bucket, seq)
WHERE lv.price IS DISTINCT FROM starting_price AND lv.price IS DISTINCT FROM sold_price
UNION ALL
SELECT {e}, passage_no, 3, 1, date, sold_price, CASE WHEN total > 1 THEN 'Adjugé P' || passage_no ELSE 'Adjugé' END
FROM kept JOIN tot USING ({e}) WHERE sold_price IS NOT NULL"""),
    ]


def identity_ctes(newest_first: bool = False, hashed_only: bool = False) -> list[tuple[str, str]]:
    """fx_entities with their history reference, and their snapshots in ``idsnap``."""
    order = "DESC" if newest_first else "ASC"
    where = "WHERE e.hash_id IS NOT NULL" if hashed_only else ""
    return [
        view("fx_snapshots"),
        view("fx_entities"),
        ("fref", f"""
SELECT vehicle_id, reference AS found FROM fx_snapshots WHERE reference IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at {order}, id {order}) = 1"""),
        ("ents", f"""
SELECT e.* REPLACE (coalesce(e.reference, f.found) AS reference) FROM fx_entities e LEFT JOIN fref f ON f.vehicle_id = e.id {where}"""),
        ("idsnap", """
SELECT e.id AS entity_id, s.* FROM ents e JOIN (
  SELECT DISTINCT e.id AS eid, s.id AS sid FROM ents e JOIN fx_snapshots s ON s.vehicle_id = e.id
  UNION SELECT e.id, s.id FROM ents e JOIN fx_snapshots s ON s.reference = e.reference
  UNION SELECT e.id, s.id FROM ents e JOIN fx_snapshots s ON s.hash_id = e.hash_id) m ON m.eid = e.id
JOIN fx_snapshots s ON s.id = m.sid"""),
    ]

"""Expected results of the page queries.

Pages built from lots must give back the facts of the lots.
"""

from __future__ import annotations

from oracles.base import view, with_ctes

LOTS = view("fx_lots")
# Amounts of 100 next to proof are placeholders on cards and details.
START = "CASE WHEN NOT (starting_price = 100 AND coalesce(sold_price,0) >= 500) THEN starting_price END"
LIVE = "CASE WHEN status = 'available' AND mileage % 3 = 0 THEN starting_price + 500 END"
LETTERS = "translate(brand, '#0123456789', 'ABCDEFGHIJK')"
DOCUMENTS = {
    "ct": "CASE WHEN ct_available THEN 'https://cdn.example.com/a' || md5(id) || '_CT.pdf' END",
    "bilan": "CASE WHEN mileage % 4 = 0 THEN '/f' || (mileage % 500 + 1) || '.pdf' END",
    "suivi": "CASE WHEN mileage % 5 = 0 THEN 'https://cdn.example.com/a' || md5(id) || '_SE.pdf' END",
    "batterie": "CASE WHEN mileage % 7 = 0 THEN '/b.pdf?l=' || (mileage % 500 + 1) END",
}

SQL = {
    "page_type": r"""
SELECT page_id, CASE WHEN regexp_matches(url, '^https://(?:www\.)?[^/]+/vehicule/([a-f0-9]+)/') THEN 'detail'
  WHEN regexp_matches(url, '(?i)/(vehicule|enchere|selection)/(liste|resultats)') OR contains(url, '/rechercher/') OR contains(url, '/recherche/')
    OR contains(url, '?vente=') OR contains(url, '?recherche=') THEN 'list' ELSE 'unknown' END AS page_type,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '')
    || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) AS normal_url,
  regexp_extract(u, '^([^#]*)', 1) || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 'page=3' || regexp_extract(u, '(#.*)$', 1) AS page_3
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(url, '([?&])page=[^&#]*&', '\1'), '[?&]page=[^&#]*(#|$)', '\1'), '[?&](#|$)', '\1') AS u FROM pages) p""",
    "page_links": r"""
SELECT page_id, len(regexp_extract_all(html, '(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>')) AS n_links,
  greatest(1, coalesce(list_max(list_transform(regexp_extract_all(html, '<a\b[^>]*href="[^"]*page=(\d+)', 1), lambda x: TRY_CAST(x AS BIGINT))), 1)) AS max_page FROM pages""",
    "list_cards": with_ctes([LOTS], f"""
SELECT auction_id AS page_id, 'a' || md5(id) AS hash_id, {LETTERS} AS brand, model || CASE WHEN year % 2 = 0 THEN ' Élite ß' ELSE '' END AS model, year, mileage,
  {START} AS starting_price, {LIVE} AS live_price, sold_price, status, 130 AS power, 'BVA8' AS transmission, ct_available, 'P' || mileage AS photo_hash,
  mileage % 500 + 1 AS lot_number, city, CAST(mileage + 1000000 AS VARCHAR) AS reference FROM fx_lots"""),
    "list_max_page": with_ctes([LOTS], "SELECT DISTINCT auction_id AS page_id, greatest(2, auction_id % 40) AS max_page FROM fx_lots"),
    "page_hash": with_ctes([view("fx_snapshots")], """
SELECT page_id, nullif(regexp_extract(u, '/vehicule/([a-f0-9]+)/', 1), '') AS hash_id FROM (
  SELECT id AS page_id, source_url AS u FROM fx_snapshots UNION ALL SELECT page_id, url FROM pages) x"""),
    "detail_rows": with_ctes([LOTS], f"""
SELECT id, {LETTERS} AS brand, year, mileage, 'GO' AS fuel, 130 AS power, 7 AS fiscal_power, city, CAST(mileage % 80 + 10 AS VARCHAR) AS department,
  CASE WHEN greatest(starting_price, 100) <> 100 THEN greatest(starting_price, 100) END AS starting_price, {LIVE} AS live_price,
  27600 AS market_value, sold_price, CASE WHEN {LIVE} IS NOT NULL THEN 'auction_live' ELSE status END AS status,
  CAST(mileage + 1000000 AS VARCHAR) AS reference, CASE WHEN ct_available THEN 'https://cdn.example.com/a' || md5(id) || '_CT.pdf' END AS technical_check_url,
  model || ' Confort' AS version, CASE WHEN mileage % 2 = 0 OR scraped_at BETWEEN TIMESTAMP '1995-06-03' AND TIMESTAMP '1995-10-15' THEN strftime(scraped_at, '%Y-%m-%d') END AS sale_date,
  mileage % 500 + 1 AS lot_number, coalesce(observations = 'NON ROULANT', false) AS not_drivable, 'P' || mileage AS photo_hash FROM fx_lots"""),
    "document_links": with_ctes([LOTS], f"SELECT id, {', '.join(f'{u} AS {k}_url' for k, u in DOCUMENTS.items())} FROM fx_lots"),
    "document_coverage": with_ctes([LOTS], " UNION ALL ".join(
        f"SELECT '{k}' AS kind, count({u}) AS available, count(*) - count({u}) AS missing FROM fx_lots" for k, u in DOCUMENTS.items())),
    "equipment": with_ctes([LOTS], "SELECT id, CASE WHEN mileage % 11 <> 0 THEN 'GPS' || chr(10) || 'Siège ' || (mileage % 500 + 1) END AS section_text FROM fx_lots"),
}

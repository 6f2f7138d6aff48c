"""Expected results of the change, badge, capture, batch, watch and repair queries."""

from __future__ import annotations

from oracles.base import chain_ctes, view, with_ctes

SNAP, ENT, BATCH = view("fx_snapshots"), view("fx_entities"), view("fx_list_batch")


def num(x: str) -> str:
    return f"replace(format('{{:,}}', {x}), ',', chr(8239))"


def money(x: str) -> str:
    return f"coalesce({num(x)} || ' €', '—')"


def signed(x: str, unit: str) -> str:
    return f"CASE WHEN {x} > 0 THEN '+' ELSE '' END || {num(x)} || '{unit}'"


def reason(p: str, n: str) -> str:
    """Reason text between the rows aliased ``p`` (before) and ``n`` (after)."""
    parts = f"""concat_ws(' · ',
  CASE WHEN {p}starting_price IS DISTINCT FROM {n}starting_price THEN 'Prix ' || {money(p + 'starting_price')} || ' → ' || {money(n + 'starting_price')} END,
  CASE WHEN {p}status IS DISTINCT FROM {n}status THEN 'Statut ' || {p}status || ' → ' || {n}status END,
  CASE WHEN {p}city IS DISTINCT FROM {n}city THEN 'Ville ' || coalesce({p}city,'?') || ' → ' || coalesce({n}city,'?') END,
  CASE WHEN {p}sale_date IS DISTINCT FROM {n}sale_date THEN 'Date ' || coalesce({p}sale_date,'?') || ' → ' || coalesce({n}sale_date,'?') END)"""
    return f"CASE WHEN {parts} = '' THEN 'Modifié' ELSE {parts} END"


PK = ("pk", """
SELECT vehicle_id, count(DISTINCT coalesce(nullif(city,''),'unknown') || '|' || coalesce(nullif(sale_date,''), strftime(scraped_at,'%Y-%m-%d'))) AS n
FROM fx_snapshots GROUP BY 1""")
BADGES = [SNAP, PK, ("pr", """
SELECT vehicle_id, max(CASE WHEN rn = 1 THEN starting_price END) - max(CASE WHEN rn = 2 THEN starting_price END) AS diff FROM (
  SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at DESC, id DESC) AS rn FROM fx_snapshots WHERE starting_price IS NOT NULL) x
GROUP BY 1"""), ("ps", """
SELECT vehicle_id, status AS ps FROM fx_snapshots QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at DESC, id DESC) = 2"""),
    ("bd", """
SELECT vehicle_id, 'new' AS type, 'Nouveau' AS label, NULL AS detail FROM pk WHERE n = 1
UNION ALL SELECT vehicle_id, 'seen', 'Vu ' || n || ' fois', n || ' passages' FROM pk WHERE n > 1
UNION ALL SELECT vehicle_id, 'price_drop', 'Baisse de prix', diff || ' €' FROM pk JOIN pr USING (vehicle_id) WHERE n > 1 AND diff < 0
UNION ALL SELECT vehicle_id, 'price_up', 'Hausse de prix', '+' || diff || ' €' FROM pk JOIN pr USING (vehicle_id) WHERE n > 1 AND diff > 0
UNION ALL SELECT vehicle_id, 'reappeared', 'Repasse en vente', NULL FROM pk JOIN ps USING (vehicle_id) WHERE n > 1 AND ps IN ('removed','unsold')""")]

CAPTURES = ("cap", """
SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY vehicle_id) AS n, lag(starting_price) OVER w AS p_starting_price,
  lag(status) OVER w AS p_status, lag(city) OVER w AS p_city, lag(sale_date) OVER w AS p_sale_date
FROM fx_snapshots WHERE has_screenshot WINDOW w AS (PARTITION BY vehicle_id ORDER BY scraped_at, id)""")

PLAN = [SNAP, ENT, ("nowt", "SELECT max(scraped_at) AS now FROM fx_snapshots"),
    ("lat", "SELECT * FROM fx_snapshots QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at DESC, id DESC) = 1"),
    ("capt", "SELECT * FROM fx_snapshots WHERE has_screenshot QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at DESC, id DESC) = 1"),
    ("plan0", """
SELECT e.id AS vehicle_id, e.hash_id, e.first_seen_at, now, l.id AS snapshot_id, l.photo_urls, l.has_screenshot AS l_shot, l.scraped_at AS l_at,
  l.starting_price AS l_starting_price, l.status AS l_status, l.city AS l_city, l.sale_date AS l_sale_date, c.id AS cid,
  c.starting_price AS c_starting_price, c.status AS c_status, c.city AS c_city, c.sale_date AS c_sale_date,
  CASE WHEN json_valid(l.photo_urls) THEN json_extract_string(l.photo_urls, '$[0]') END AS thumb_url
FROM fx_entities e CROSS JOIN nowt LEFT JOIN lat l ON l.vehicle_id = e.id LEFT JOIN capt c ON c.vehicle_id = e.id WHERE e.hash_id IS NOT NULL"""),
    ("plan", """
SELECT *, CASE WHEN snapshot_id IS NULL OR thumb_url IS NULL OR (l_shot AND l_at > now - INTERVAL 60 MINUTE) THEN 'skipped'
  WHEN cid IS NULL AND first_seen_at >= now - INTERVAL 29 DAY - INTERVAL 12 HOUR THEN 'new' WHEN cid IS NULL THEN 'missing'
  WHEN l_starting_price IS DISTINCT FROM c_starting_price OR l_status <> c_status OR l_city <> c_city OR l_sale_date IS DISTINCT FROM c_sale_date
  THEN 'modified' ELSE 'skipped' END AS bucket FROM plan0""")]

LOG = [SNAP, ("lg0", "SELECT *, CASE WHEN json_valid(photo_urls) THEN CAST(json_array_length(photo_urls) AS BIGINT) ELSE 0 END AS photos FROM fx_snapshots"),
    ("lg", """
SELECT *, row_number() OVER w AS rn, lag(starting_price) OVER w AS p_starting_price, lag(sold_price) OVER w AS p_sold_price,
  lag(market_value) OVER w AS p_market_value, lag(mileage) OVER w AS p_mileage, lag(status) OVER w AS p_status, lag(lot_number) OVER w AS p_lot_number,
  lag(city) OVER w AS p_city, lag(sale_date) OVER w AS p_sale_date, lag(observations) OVER w AS p_observations, lag(photos) OVER w AS p_photos
FROM lg0 WINDOW w AS (PARTITION BY vehicle_id ORDER BY scraped_at, id)""")]


def money_diff(no: int, field: str, label: str) -> str:
    delta = f"(coalesce({field},0) - coalesce(p_{field},0))"
    return f"""SELECT id, vehicle_id, {no} AS ord, '{field}' AS field, '{label}' AS label, {money('p_' + field)} AS before, {money(field)} AS after,
  CASE WHEN {delta} > 0 THEN 'up' WHEN {delta} < 0 THEN 'down' ELSE 'neutral' END AS direction,
  CASE WHEN {delta} <> 0 THEN {signed(delta, ' €')} END AS delta FROM lg WHERE rn > 1 AND p_{field} IS DISTINCT FROM {field}"""


def text_diff(no: int, field: str, label: str, before: str, after: str, cond: str) -> str:
    return f"""SELECT id, vehicle_id, {no}, '{field}', '{label}', coalesce(nullif({before},''),'—'), coalesce(nullif({after},''),'—'), 'neutral', NULL
FROM lg WHERE rn > 1 AND {cond}"""


def status(x: str) -> str:
    return f"CASE {x} WHEN 'auction_live' THEN 'Enchere en cours' WHEN 'sold' THEN 'Vendu' WHEN 'unsold' THEN 'Invendu' WHEN 'removed' THEN 'Retire' ELSE 'Disponible' END"


def fr(x: str) -> str:
    return f"regexp_replace({x}, '^(\\d{{4}})-(\\d{{2}})-(\\d{{2}}).*$', '\\3/\\2/\\1')"


DIFF = LOG + [("df", "\nUNION ALL\n".join([
    money_diff(1, "starting_price", "Mise a prix"),
    money_diff(2, "sold_price", "Prix adjuge"),
    money_diff(4, "market_value", "Cote"),
    f"""SELECT id, vehicle_id, 5, 'mileage', 'Kilometrage', {num('p_mileage')} || ' km', {num('mileage')} || ' km',
  CASE WHEN mileage > p_mileage THEN 'up' ELSE 'down' END, {signed('(mileage - p_mileage)', ' km')} FROM lg WHERE rn > 1 AND mileage <> p_mileage""",
    text_diff(6, "status", "Statut", status("p_status"), status("status"), "status <> p_status"),
    text_diff(7, "lot_number", "Numero de lot", "'N°' || p_lot_number", "'N°' || lot_number", "lot_number IS DISTINCT FROM p_lot_number"),
    text_diff(8, "city", "Ville", "p_city", "city", "city <> p_city"),
    text_diff(9, "sale_date", "Date de vente", fr("p_sale_date"), fr("sale_date"), "coalesce(sale_date,'') <> coalesce(p_sale_date,'')"),
    text_diff(10, "observations", "Observations", "p_observations", "observations", "coalesce(observations,'') <> coalesce(p_observations,'')"),
    """SELECT id, vehicle_id, 11, 'photos', 'Photos', p_photos || CASE WHEN p_photos > 1 THEN ' photos' ELSE ' photo' END,
  photos || CASE WHEN photos > 1 THEN ' photos' ELSE ' photo' END, CASE WHEN photos > p_photos THEN 'up' ELSE 'down' END,
  CASE WHEN photos > p_photos THEN '+' ELSE '' END || (photos - p_photos) FROM lg WHERE rn > 1 AND photos - p_photos NOT IN (0, -1)""",
]))]

KIND = DIFF + [("kd0", """
SELECT lg.id, lg.vehicle_id, lg.brand, lg.model, lg.source_url, lg.observations, rn, count(df.field) AS n,
  max(CASE WHEN field = 'starting_price' THEN direction END) AS price, max(CASE WHEN field = 'status' THEN 1 END) AS st,
  max(CASE WHEN field = 'starting_price' THEN 'Mise a prix: ' || before || ' → ' || after || coalesce(' (' || delta || ')', '') END) AS price_text,
  max(CASE WHEN field = 'status' THEN 'Statut: ' || before || ' → ' || after END) AS st_text,
  array_to_string(list_slice(list(df.label ORDER BY ord), 1, 2), ', ') AS preview
FROM lg LEFT JOIN df ON df.id = lg.id GROUP BY ALL"""), ("kd", """
SELECT *, CASE WHEN rn = 1 THEN 'new' WHEN price = 'up' THEN 'price_up' WHEN price = 'down' THEN 'price_down' WHEN st = 1 THEN 'status_change'
  WHEN n > 0 THEN 'updated' END AS kind FROM kd0"""), ("kx", """
SELECT *, CASE WHEN kind = 'new' THEN 'Nouveau vehicule enregistre.' WHEN kind IN ('price_up','price_down') THEN price_text
  WHEN kind = 'status_change' THEN st_text WHEN kind = 'updated' THEN n || CASE WHEN n > 1 THEN ' modifications: ' ELSE ' modification: ' END || preview
    || CASE WHEN n > 2 THEN ', +' || (n - 2) ELSE '' END END AS detail FROM kd""")]

DELTA = [SNAP, ENT, BATCH, ("own", """
SELECT b.*, coalesce((SELECT min(id) FROM fx_entities e WHERE e.hash_id = b.hash_id), (SELECT min(id) FROM fx_entities e WHERE e.reference = b.reference)) AS owner
FROM fx_list_batch b"""), ("prev", """
SELECT o.hash_id, o.owner, s.scraped_at AS p_at, s.starting_price AS p_price FROM own o JOIN fx_snapshots s ON s.vehicle_id = o.owner AND s.scraped_at < o.scraped_at
QUALIFY row_number() OVER (PARTITION BY o.hash_id, o.owner ORDER BY s.scraped_at DESC, s.id DESC) = 1"""), ("dl", """
SELECT o.hash_id, o.owner AS vehicle_id, o.owner IS NULL AS is_new, coalesce(p_at >= o.scraped_at - INTERVAL 6 HOUR, false) AS suppressed,
  CASE WHEN NOT coalesce(p_at >= o.scraped_at - INTERVAL 6 HOUR, false) THEN nullif(nullif(o.starting_price,0) - nullif(p_price,0), 0) END AS price_changed,
  CASE WHEN NOT coalesce(p_at >= o.scraped_at - INTERVAL 6 HOUR, false)
       AND NOT (o.starting_price = 100 AND (coalesce(live_price,0) >= 500 OR coalesce(sold_price,0) >= 500)) THEN o.starting_price END AS stored_price
FROM own o LEFT JOIN prev p ON p.hash_id = o.hash_id AND p.owner = o.owner"""),
    ("gone", """
SELECT e.id AS vehicle_id, e.hash_id, e.brand, e.model, coalesce(l.city,'') AS last_city, coalesce(l.starting_price,0) AS last_price
FROM fx_entities e JOIN (SELECT * FROM fx_snapshots QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at DESC, id DESC) = 1) l ON l.vehicle_id = e.id
WHERE e.hash_id IS NOT NULL AND l.status = 'available' AND e.last_seen_at >= (SELECT max(scraped_at) FROM fx_list_batch) - INTERVAL 7 DAY
  AND e.hash_id NOT IN (SELECT hash_id FROM fx_list_batch)""")]

VISITS = [view("fx_visits"), ("vs", """
SELECT *, 'vehicle:' || nullif(vehicle_id,0) AS k_id, 'hash:' || hash_id AS k_hash, 'ref:' || reference AS k_ref,
  coalesce('vehicle:' || nullif(vehicle_id,0), 'hash:' || hash_id, 'ref:' || reference) AS canonical FROM fx_visits"""),
    ("rr", """
SELECT *, first_value(CASE WHEN canonical <> k_ref THEN {'c': canonical, 't': visited_at, 'i': visit_id} END IGNORE NULLS) OVER
  (PARTITION BY k_ref ORDER BY visited_at, visit_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM vs WHERE k_ref IS NOT NULL"""),
    ("tok", """
SELECT coalesce(nx.c, canonical) AS at_key, coalesce(nx.t, visited_at) AS t, coalesce(nx.i, visit_id) AS i FROM rr WHERE canonical = k_ref
UNION ALL SELECT canonical, visited_at, visit_id FROM vs WHERE canonical IS NOT NULL AND canonical IS DISTINCT FROM k_ref"""),
    ("hh", """
SELECT k_hash, visited_at AS t, visit_id AS i, first_value(CASE WHEN canonical <> k_hash THEN canonical END IGNORE NULLS) OVER
  (PARTITION BY k_hash ORDER BY visited_at, visit_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM vs WHERE k_hash IS NOT NULL"""),
    ("fin", """
SELECT coalesce(hh.nx, tok.at_key) AS visit_key FROM tok LEFT JOIN hh ON hh.k_hash = tok.at_key AND hh.i = tok.i"""),
    ("vc", """
SELECT f.visit_key, f.n AS visit_count, l.last_visited_at, l.last_source_url, l.label FROM (SELECT visit_key, count(*) AS n FROM fin GROUP BY 1) f JOIN (
  SELECT canonical AS visit_key, epoch_us(max(visited_at)) AS last_visited_at, last(source_url ORDER BY visited_at, visit_id) AS last_source_url,
    last(brand || ' ' || model ORDER BY visited_at, visit_id) AS label FROM vs WHERE canonical IS NOT NULL GROUP BY 1) l USING (visit_key)""")]

RULES = [SNAP, ("fl", """
SELECT *, vehicle_id IN (SELECT vehicle_id FROM fx_snapshots WHERE starting_price >= 500) AS a,
  coalesce(market_value,0) >= 1000 OR coalesce(new_price,0) >= 1000 AS b, coalesce(live_price,0) >= 1000 AS c
FROM fx_snapshots WHERE starting_price = 100""")]

SPLIT = [SNAP, ENT, ("ph", """
SELECT vehicle_id, hash_id, count(*) AS n_snapshots, min(scraped_at) AS first_seen_at, max(scraped_at) AS last_seen_at,
  max({'t': scraped_at, 'i': id}) AS last FROM fx_snapshots WHERE hash_id IS NOT NULL GROUP BY 1, 2"""), ("cn", """
SELECT ph.vehicle_id, coalesce(max(CASE WHEN ph.hash_id = e.hash_id THEN ph.hash_id END), last(ph.hash_id ORDER BY ph.last)) AS canonical_hash
FROM ph JOIN fx_entities e ON e.id = ph.vehicle_id GROUP BY 1 HAVING count(*) > 1"""), ("sp", """
SELECT ph.vehicle_id, ph.hash_id, canonical_hash, n_snapshots, (SELECT min(id) FROM fx_entities e WHERE e.hash_id = ph.hash_id AND e.id <> ph.vehicle_id) AS target_id,
  epoch_us(first_seen_at) AS first_seen_at, epoch_us(last_seen_at) AS last_seen_at
FROM ph JOIN cn USING (vehicle_id) WHERE ph.hash_id <> canonical_hash""")]

RESOLVED = [SNAP, BATCH] + chain_ctes() + [("cur", "SELECT * FROM fx_snapshots QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at DESC, id DESC) = 1"),
    ("card", "SELECT hash_id, min(starting_price) AS card_price FROM fx_list_batch GROUP BY 1"),
    ("sig", """
SELECT vehicle_id, (coalesce(live_price,0) >= 500 OR coalesce(sold_price,0) >= 500 OR coalesce(market_value,0) >= 1000 OR coalesce(new_price,0) >= 1000) AS bad FROM cur"""),
    ("pp", """
SELECT k.vehicle_id, last(k.starting_price ORDER BY passage_no) AS pprice FROM kept k JOIN sig USING (vehicle_id)
WHERE k.starting_price <> 0 AND NOT (bad AND k.starting_price = 100) GROUP BY 1"""),
    ("rs", """
SELECT cur.vehicle_id, cur.status, cur.city, cur.live_price, cur.sold_price, cur.market_value,
  coalesce(CASE WHEN cur.starting_price <> 0 AND NOT (bad AND cur.starting_price = 100) THEN cur.starting_price END,
           CASE WHEN card_price <> 0 AND NOT (bad AND card_price = 100) THEN card_price END, pprice) AS resolved_price
FROM cur JOIN sig USING (vehicle_id) LEFT JOIN card ON card.hash_id = cur.hash_id LEFT JOIN pp ON pp.vehicle_id = cur.vehicle_id""")]

CURRENT_CITY = """
SELECT k.*, CASE WHEN k.starting_price IS NULL AND r.resolved_price > 0 AND k.city = r.city
  AND passage_no = max(CASE WHEN k.city = r.city THEN passage_no END) OVER (PARTITION BY k.vehicle_id) THEN r.resolved_price END AS patch
FROM kept0 k JOIN rs r USING (vehicle_id)"""

SQL = {
    "badges": with_ctes(BADGES, "SELECT * FROM bd"),
    "list_badges": with_ctes(BADGES + [ENT, BATCH], """
SELECT b.hash_id, e.id AS vehicle_id, type, label, detail FROM fx_list_batch b LEFT JOIN fx_entities e ON e.hash_id = b.hash_id
LEFT JOIN bd ON bd.vehicle_id = e.id"""),
    "passage_key_count": with_ctes([SNAP, PK], "SELECT vehicle_id, n AS passage_count FROM pk"),
    "capture_timeline": with_ctes([SNAP, CAPTURES], f"""
SELECT vehicle_id, id AS snapshot_id, CASE WHEN rn = 1 THEN 'Première capture' ELSE {reason('p_', '')} END AS reason FROM cap"""),
    "retention": with_ctes([SNAP, CAPTURES], "SELECT vehicle_id, id AS snapshot_id FROM cap WHERE n > 20 AND rn > 1 AND rn <= 1 + n - 20"),
    "capture_plan": with_ctes(PLAN, f"""
SELECT vehicle_id, hash_id, bucket, CASE bucket WHEN 'new' THEN 'Nouveau véhicule' WHEN 'missing' THEN 'Jamais capturé'
  WHEN 'modified' THEN {reason('c_', 'l_')} END AS reason, snapshot_id, thumb_url FROM plan"""),
    "plan_counts": with_ctes(PLAN, "SELECT bucket, count(*) AS n FROM plan GROUP BY 1"),
    "snapshot_diff": with_ctes(DIFF, "SELECT id AS snapshot_id, vehicle_id, field, label, before, after, direction, delta FROM df"),
    "change_kind": with_ctes(KIND, "SELECT id AS snapshot_id, vehicle_id, kind, detail FROM kx"),
    "change_search": with_ctes(KIND + [("hit", """
SELECT id AS snapshot_id, kind, brand || ' ' || model AS label FROM kx
WHERE kind = 'price_down' AND contains(lower(strip_accents(concat_ws(' ', brand, model, detail, source_url))), 'brand3')""")], """
SELECT *, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY snapshot_id LIMIT 12 OFFSET (SELECT (least(2, greatest(1, CAST(ceil(count(*) / 12.0) AS INT))) - 1) * 12 FROM hit)"""),
    "run_counters": with_ctes(KIND + [("kq", "SELECT *, coalesce(observations = 'Véhicule non roulant', false) AS bad FROM kx")], """
SELECT count(*) AS processed, count(*) FILTER (WHERE NOT bad) AS saved, count(*) FILTER (WHERE bad) AS failed,
  count(*) FILTER (WHERE kind = 'new') AS new_vehicles, count(*) FILTER (WHERE kind IN ('price_up','price_down','status_change','updated')) AS updated,
  count(*) FILTER (WHERE kind IS NULL AND NOT bad) AS unchanged, count(*) FILTER (WHERE kind = 'price_up') AS price_ups,
  count(*) FILTER (WHERE kind = 'price_down') AS price_downs, count(*) FILTER (WHERE st = 1) AS status_changes FROM kq"""),
    "last_errors": with_ctes([SNAP], """
SELECT id, vehicle_id, 'detail_scrape_failed' AS error FROM fx_snapshots WHERE observations = 'Véhicule non roulant' ORDER BY id DESC LIMIT 5"""),
    "batch_delta": with_ctes(DELTA, "SELECT hash_id, vehicle_id, is_new, suppressed, price_changed, stored_price FROM dl"),
    "disappeared": with_ctes(DELTA, "SELECT * FROM gone"),
    "batch_summary": with_ctes(DELTA, """
SELECT count(*) AS saved, count(*) FILTER (WHERE is_new) AS new_vehicles, count(price_changed) AS price_changes,
  (SELECT count(DISTINCT hash_id) FROM gone) AS disappeared FROM dl"""),
    "alerts": with_ctes(DELTA, """
SELECT count(*) FILTER (WHERE is_new) AS "new", count(*) FILTER (WHERE price_changed < 0) AS drops, count(*) FILTER (WHERE price_changed > 0) AS rises,
  (SELECT count(*) FROM gone) AS disappeared,
  (SELECT coalesce(string_agg(brand || ' ' || model, ', ' ORDER BY vehicle_id), '') FROM (SELECT * FROM gone ORDER BY vehicle_id LIMIT 3) g) AS first_three FROM dl"""),
    "list_dedup": with_ctes([SNAP], """
SELECT hash_id, id, status FROM fx_snapshots WHERE hash_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hash_id ORDER BY scraped_at, id) = 1"""),
    "import_targets": with_ctes([SNAP], """
SELECT source_url AS url, concat_ws(' • ', brand, model, city) AS label FROM fx_snapshots
QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY scraped_at, id) = 1"""),
    "api_rows": with_ctes([SNAP], """
SELECT id AS snapshot_id, coalesce(reference,'') AS reference, coalesce(hash_id,'') AS hash_id,
  CASE photo_urls WHEN '["p1"]' THEN 'p1' WHEN '["p1","p2"]' THEN 'p1,p2' ELSE '' END AS photos,
  CASE WHEN photo_urls LIKE '["p1"%' THEN 'p1' END AS thumb FROM fx_snapshots"""),
    "lookup": with_ctes([SNAP, ENT, ("hits", """
SELECT s.id AS key_id, CASE WHEN e.hash_id = s.hash_id AND e.reference = s.reference THEN 1 WHEN e.hash_id = s.hash_id THEN 2 ELSE 3 END AS priority, e.id
FROM fx_snapshots s JOIN fx_entities e ON e.hash_id = s.hash_id
UNION ALL SELECT s.id, 3, e.id FROM fx_snapshots s JOIN fx_entities e ON e.reference = s.reference"""), ("best", """
SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY key_id ORDER BY priority, id) = 1"""), ("stt", """
SELECT vehicle_id, count(*) AS n, last(id ORDER BY scraped_at, id) AS last_id FROM fx_snapshots GROUP BY 1""")], """
SELECT s.id AS key_id, priority, b.id AS vehicle_id, CASE WHEN b.id IS NOT NULL THEN coalesce(n,0) END AS total_snapshots, last_id AS last_snapshot_id
FROM fx_snapshots s LEFT JOIN best b ON b.key_id = s.id LEFT JOIN stt ON stt.vehicle_id = b.id"""),
    "with_previous_price": with_ctes([SNAP, BATCH, ("pv", """
SELECT b.vehicle_id, s.id AS prev_id, s.starting_price, s.status FROM fx_list_batch b JOIN fx_snapshots s ON s.vehicle_id = b.vehicle_id AND s.scraped_at < b.scraped_at
QUALIFY row_number() OVER (PARTITION BY b.vehicle_id ORDER BY s.scraped_at DESC, s.id DESC) = 1""")], """
SELECT b.vehicle_id, b.hash_id, prev_id, pv.starting_price AS prev_starting_price, pv.status AS prev_status FROM fx_list_batch b LEFT JOIN pv USING (vehicle_id)"""),
    "with_latest": with_ctes([SNAP, ENT], """
SELECT e.id AS vehicle_id, e.brand, l.id AS last_id, l.status AS last_status, l.city AS last_city, l.mileage AS last_mileage FROM fx_entities e LEFT JOIN (
  SELECT * FROM fx_snapshots QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at DESC, id DESC) = 1) l ON l.vehicle_id = e.id"""),
    "store_stats": with_ctes([SNAP], "SELECT city, count(*) AS n_snapshots, count(DISTINCT vehicle_id) AS n_vehicles FROM fx_snapshots GROUP BY 1"),
    "store_totals": with_ctes([SNAP, ENT], """
SELECT (SELECT count(*) FROM fx_entities) AS total_vehicles, (SELECT count(*) FROM fx_snapshots) AS total_snapshots,
  (SELECT count(DISTINCT city) FROM fx_snapshots) AS cities"""),
    "watchlist_view": with_ctes([SNAP, ENT, view("fx_watchlist")], """
SELECT w.vehicle_id, w.notes, w.alert_on_price, l.id AS last_id, l.status AS last_status, l.starting_price AS last_starting_price
FROM fx_watchlist w JOIN fx_entities e ON e.id = w.vehicle_id LEFT JOIN (
  SELECT * FROM fx_snapshots QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at DESC, id DESC) = 1) l ON l.vehicle_id = e.id"""),
    "watchlist_apply": with_ctes([SNAP, ENT, view("fx_watchlist")], """
SELECT vehicle_id, notes, alert_on_price, alert_on_reappear FROM fx_watchlist
WHERE vehicle_id NOT IN (SELECT vehicle_id FROM fx_snapshots WHERE status = 'sold' AND starting_price IS NULL AND hash_id IS NULL)
UNION ALL SELECT id, NULL, true, false FROM fx_entities WHERE id NOT IN (SELECT vehicle_id FROM fx_watchlist)"""),
    "watchlist_alerts": with_ctes(BADGES + [view("fx_watchlist")], """
SELECT w.vehicle_id, type, label, detail FROM fx_watchlist w JOIN bd USING (vehicle_id)
WHERE (type IN ('price_drop','price_up') AND alert_on_price) OR (type = 'reappeared' AND alert_on_reappear)"""),
    "visits": with_ctes(VISITS, "SELECT * FROM vc"),
    "repair_rules": with_ctes(RULES, """
SELECT id AS snapshot_id, vehicle_id, concat_ws(',', CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END) AS rules FROM fl WHERE a OR b OR c"""),
    "rule_overlaps": with_ctes(RULES, """
SELECT count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, count(*) FILTER (WHERE c) AS n_c, count(*) FILTER (WHERE a AND b) AS n_ab,
  count(*) FILTER (WHERE a AND c) AS n_ac, count(*) FILTER (WHERE b AND c) AS n_bc, count(*) FILTER (WHERE a OR b OR c) AS n_any FROM fl"""),
    "placeholder_scrub": with_ctes([SNAP], """
SELECT id AS snapshot_id, CASE WHEN NOT (starting_price = 100 AND (coalesce(live_price,0) >= 500 OR coalesce(sold_price,0) >= 500
  OR coalesce(market_value,0) >= 1000 OR coalesce(new_price,0) >= 1000)) THEN starting_price END AS stored_price FROM fx_snapshots WHERE starting_price IS NOT NULL"""),
    "polluted": with_ctes([SNAP], """
SELECT vehicle_id, count(DISTINCT hash_id) AS n_hashes FROM fx_snapshots WHERE hash_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT hash_id) > 1"""),
    "polluted_split": with_ctes(SPLIT, "SELECT *, target_id IS NULL AS creates FROM sp"),
    "polluted_moves": with_ctes(SPLIT, """
SELECT s.hash_id, CASE WHEN s.hash_id IS NULL THEN NULL ELSE sp.hash_id IS NOT NULL AND sp.target_id IS NULL END AS on_new, count(*) AS n, CAST(sum(s.id) AS BIGINT) AS id_sum
FROM fx_snapshots s LEFT JOIN sp ON sp.vehicle_id = s.vehicle_id AND sp.hash_id = s.hash_id GROUP BY 1, 2"""),
    "resolved_price": with_ctes(RESOLVED, "SELECT vehicle_id, status, resolved_price FROM rs"),
    "current_passage": with_ctes([SNAP] + chain_ctes() + [("cur", """
SELECT vehicle_id, city, center, lot_number, coalesce(nullif(sale_date,''), strftime(scraped_at,'%Y-%m-%d')) AS d FROM fx_snapshots
QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY scraped_at DESC, id DESC) = 1""")], """
SELECT p.vehicle_id, passage_no FROM pass p JOIN cur USING (vehicle_id) WHERE p.date = cur.d AND p.city = cur.city
  AND coalesce(p.center = cur.center, true) AND coalesce(p.lot_number = cur.lot_number, true)"""),
    "headline": with_ctes(RESOLVED + VISITS, """
SELECT rs.vehicle_id, rs.status, resolved_price, rs.live_price, rs.sold_price, rs.market_value, coalesce(visit_count,0) AS visit_count,
  greatest(coalesce(total_passages,1) - 1, 0) AS previous_passages,
  CASE WHEN resolved_price <> 0 THEN rs.sold_price - resolved_price END AS vs_start,
  CAST(round((rs.sold_price - resolved_price) * 100.0 / nullif(resolved_price,0)) AS BIGINT) AS vs_start_pct,
  CASE WHEN rs.market_value <> 0 THEN rs.sold_price - rs.market_value END AS vs_market,
  CAST(round((rs.sold_price - rs.market_value) * 100.0 / nullif(rs.market_value,0)) AS BIGINT) AS vs_market_pct
FROM rs LEFT JOIN evo USING (vehicle_id) LEFT JOIN vc ON vc.visit_key = 'vehicle:' || rs.vehicle_id"""),
}

# The patched history recomputes the evolution over patched passages.
_patched = [(n, t) for n, t in RESOLVED if n not in ("evo0", "evo1", "evo", "tot", "points")]
_chain = dict(chain_ctes())
SQL["patch_history"] = with_ctes(
    [(("kept0", t) if n == "kept" else (n, t.replace("FROM kept ", "FROM kept0 "))) for n, t in _patched]
    + [("patched", CURRENT_CITY), ("kept", "SELECT * REPLACE (coalesce(starting_price, patch) AS starting_price) FROM patched"),
       ("evo0", _chain["evo0"]), ("evo1", _chain["evo1"])],
    """SELECT vehicle_id, n_patched, first_starting_price, last_effective_price, evolution_amount
FROM evo1 JOIN (SELECT vehicle_id, count(patch) AS n_patched FROM patched GROUP BY 1) USING (vehicle_id)""",
)

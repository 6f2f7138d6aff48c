"""Expected results of the similarity, price, auction and identity queries."""

from __future__ import annotations

from oracles.base import chain_ctes, view, with_ctes
from oracles.tracking import BADGES

VEH, LOTS, REC = view("fx_vehicles"), view("fx_lots"), view("fx_records")

ITEMS = [VEH, ("it", """
SELECT id, brand, model, version, year, reference, hash_id, status, starting_price, source_url, auction_id, l_mileage AS mileage,
  l_color AS color, l_fuel AS fuel, l_transmission AS transmission, l_engine_size AS engine_size, l_power AS power FROM fx_vehicles WHERE l_mileage IS NOT NULL"""),
    ("pr0", """
SELECT q.id AS qid, c.id AS cid, CASE
  WHEN NOT (contains(lower(q.model), lower(c.model)) OR contains(lower(c.model), lower(q.model))) THEN 15
  WHEN q.power <> 0 AND c.power <> 0 AND abs(q.power - c.power) > greatest(25, floor(q.power * 0.2 + 0.5)) THEN 0
  ELSE least(100, 15 + CASE WHEN lower(q.model) = lower(c.model) THEN 25 ELSE 15 END
   + CASE WHEN q.version <> '' AND lower(q.version) = lower(c.version) THEN 10 ELSE 0 END
   + CASE abs(q.year - c.year) WHEN 0 THEN 15 WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END
   + CASE WHEN abs(q.mileage - c.mileage) <= 5000 THEN 10 WHEN abs(q.mileage - c.mileage) <= 15000 THEN 7 WHEN abs(q.mileage - c.mileage) <= 30000 THEN 3 ELSE 0 END
   + CASE WHEN lower(q.fuel) = lower(c.fuel) THEN 8 ELSE 0 END + CASE WHEN lower(q.transmission) = lower(c.transmission) THEN 7 ELSE 0 END
   + CASE WHEN lower(q.color) = lower(c.color) THEN 5 ELSE 0 END
   + CASE WHEN q.engine_size <> 0 AND q.engine_size = c.engine_size THEN 3 ELSE 0 END
   + CASE WHEN q.power <> 0 AND q.power = c.power THEN 2 ELSE 0 END) END AS score
FROM it q JOIN it c ON lower(q.brand) = lower(c.brand) AND q.id <> c.id"""),
    ("pr", """
SELECT *, CASE WHEN score >= 90 THEN 'exact' WHEN score >= 60 THEN 'same_model' ELSE 'similar' END AS level FROM pr0 WHERE score >= 40""")]


def trim(x: str) -> str:
    tail = f"trim(regexp_extract({x}, '(?i)\\bch\\s+(.+)$', 1))"
    return f"trim(regexp_replace({tail}, '(?i)^(?:S\\s*tronic|DSG|EDC|EAT|BVA|BVM|CVT|tiptronic|automatique|manuelle|DCT|PowerShift|tronic)\\s*\\d*\\s+', ''))"


def versus(a: str, b: str, lead: str = "", unit: str = "") -> str:
    return f"CASE WHEN coalesce({a},'') <> '' AND coalesce({b},'') <> '' AND lower({a}) <> lower({b}) THEN '{lead}' || {a} || '{unit} vs ' || {b} || '{unit}' END"


DELTAS = f"""concat_ws(' · ',
  CASE WHEN c.year <> q.year THEN CASE WHEN c.year > q.year THEN '+' ELSE '' END || (c.year - q.year) || ' an' || CASE WHEN abs(c.year - q.year) > 1 THEN 's' ELSE '' END END,
  CASE WHEN nullif(c.power,0) <> nullif(q.power,0) THEN CASE WHEN c.power > q.power THEN '+' ELSE '' END || (c.power - q.power) || ' ch' END,
  {versus(trim('c.version'), trim('q.version'))}, {versus('c.fuel', 'q.fuel')}, {versus('c.transmission', 'q.transmission', 'Boîte ')},
  CASE WHEN c.power IS NOT DISTINCT FROM q.power AND nullif(c.engine_size,0) <> nullif(q.engine_size,0) THEN c.engine_size || ' cc vs ' || q.engine_size || ' cc' END,
  {versus('c.color', 'q.color')})"""

OFFERS = ITEMS + [("of0", f"""
SELECT q.id, c.id AS offer_id, p.score, p.level, c.starting_price - nullif(q.starting_price,0) AS price_diff, c.mileage - q.mileage AS km_diff,
  CASE WHEN p.score >= 80 THEN 'good' WHEN p.score >= 65 THEN 'warn' ELSE 'bad' END AS tone, {DELTAS} AS deltas, c.status
FROM pr p JOIN it q ON q.id = p.qid JOIN it c ON c.id = p.cid
WHERE p.level <> 'exact' AND c.status IN ('available','auction_live','unsold') AND NOT coalesce(c.hash_id = q.hash_id, false)
  AND NOT coalesce(c.reference = q.reference, false) AND NOT coalesce(c.source_url = q.source_url, false)
  AND NOT (upper(c.model) = upper(q.model) AND c.year = q.year AND abs(c.mileage - q.mileage) <= 500)
  AND NOT (c.hash_id IS NOT NULL AND c.auction_id = q.auction_id)"""), ("off", """
SELECT id, row_number() OVER (PARTITION BY id ORDER BY CASE level WHEN 'same_model' THEN 2 ELSE 1 END DESC,
  CASE status WHEN 'available' THEN 2 WHEN 'auction_live' THEN 1 ELSE 0 END DESC, price_diff ASC NULLS LAST, score DESC, offer_id) AS rank,
  offer_id, score, level, price_diff, km_diff, tone, deltas FROM of0 QUALIFY rank <= 8""")]

SAME = [VEH, ("sm0", """
SELECT q.id, q.year, q.l_mileage, q.starting_price, c.id AS cid, c.year AS cyear, c.l_mileage AS ckm, c.starting_price AS cprice
FROM fx_vehicles q JOIN fx_vehicles c ON c.brand = upper(q.brand) AND contains(upper(c.model), upper(q.model)) AND c.id <> q.id
QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY c.id) <= 50"""), ("sm", "SELECT * FROM sm0 WHERE ckm IS NOT NULL"),
    ("smq", """
SELECT q.id, q.l_mileage, q.starting_price, count(sm.cid) AS n_others, avg(CASE WHEN cyear > 0 THEN cyear END) AS ay, avg(CASE WHEN ckm > 0 THEN ckm END) AS ak,
  avg(CASE WHEN cprice > 0 THEN cprice END) AS ap, coalesce(string_agg(sm.cid, ',' ORDER BY sm.cid), '') AS others
FROM fx_vehicles q LEFT JOIN sm ON sm.id = q.id GROUP BY 1, 2, 3""")]

SOLD = [LOTS, ("prof", """
SELECT DISTINCT brand, model, year, mileage, hash_id AS exclude_hash, split_part(upper(model), ' ', 1) AS word FROM fx_lots"""), ("sl0", """
SELECT p.brand, p.model, p.year, p.mileage, p.exclude_hash, p.word, l.id, l.hash_id, l.sold_price, l.observations, l.model AS lmodel,
  l.year AS lyear, l.mileage AS lkm, row_number() OVER (PARTITION BY p.exclude_hash ORDER BY l.scraped_at DESC, l.id DESC) AS rn
FROM prof p JOIN fx_lots l ON l.brand = p.brand AND l.status = 'sold' AND l.sold_price IS NOT NULL AND contains(l.model, p.word) AND l.hash_id <> p.exclude_hash
QUALIFY rn <= 50"""), ("sl1", "SELECT * FROM sl0 QUALIFY row_number() OVER (PARTITION BY exclude_hash, hash_id ORDER BY rn) = 1"), ("sl", """
SELECT *, 4 + CASE WHEN abs(lyear - year) <= 2 THEN 2 ELSE 0 END + CASE WHEN abs(lkm - mileage) <= 50000 THEN 1 ELSE 0 END AS w,
  abs(lyear - year) <= 2 AND abs(lkm - mileage) <= 50000
  AND NOT regexp_matches(coalesce(observations,'') || '|' || lmodel, '(?i)non\\s*roulant|hors\\s*d[''’]usage|[eé]pave|accident[eé]') AS fits FROM sl1"""),
    ("st", """
SELECT p.brand, p.model, p.year, p.mileage, p.exclude_hash, count(CASE WHEN fits THEN 1 END) AS n_comparable,
  CAST(floor(avg(CASE WHEN fits THEN sold_price END) + 0.5) AS BIGINT) AS avg_sold, min(CASE WHEN fits THEN sold_price END) AS min_sold,
  max(CASE WHEN fits THEN sold_price END) AS max_sold FROM prof p LEFT JOIN sl ON sl.exclude_hash = p.exclude_hash GROUP BY 1, 2, 3, 4, 5""")]

VERDICT = SOLD + [("vd0", """
SELECT l.id, l.sold_price, l.starting_price, s.*, coalesce(nullif(avg_sold,0), nullif(l.market_value,0)) AS market FROM fx_lots l JOIN st s ON s.exclude_hash = l.hash_id"""),
    ("vd1", """
SELECT *, coalesce(sold_price, starting_price, market) AS ref, coalesce(min_sold, CAST(floor(market * 0.86 + 0.5) AS BIGINT)) AS range_min,
  coalesce(max_sold, CAST(floor(market * 1.16 + 0.5) AS BIGINT)) AS range_max FROM vd0 WHERE market IS NOT NULL"""), ("vd2", """
SELECT *, (ref - market) * CAST(100.0 AS DOUBLE) / market AS diff, least(range_min, coalesce(starting_price, ref), market) * CAST(0.92 AS DOUBLE) AS lo,
  greatest(range_max, coalesce(starting_price, ref), market) * CAST(1.04 AS DOUBLE) AS hi FROM vd1"""), ("vd3", """
SELECT *, CASE WHEN diff <= -8 THEN 'good' WHEN diff >= 8 THEN 'bad' ELSE 'warn' END AS tone,
  CAST(least(95, greatest(10, floor(64 - diff * CAST(2.2 AS DOUBLE) + 0.5))) AS BIGINT) AS score FROM vd2""")]

PEERS = [LOTS, ("pe", """
SELECT a.id, a.starting_price, b.id AS peer_id, b.starting_price AS bstart, b.sold_price AS bsold, b.status AS bstatus,
  contains(upper(b.model), split_part(upper(a.model), ' ', 1)) AS matches,
  row_number() OVER (PARTITION BY a.id ORDER BY contains(upper(b.model), split_part(upper(a.model), ' ', 1)) DESC, coalesce(b.starting_price,0), b.id) AS rank
FROM fx_lots a JOIN fx_lots b ON a.auction_id = b.auction_id AND upper(a.brand) = upper(b.brand) AND a.hash_id <> b.hash_id QUALIFY rank <= 10"""), ("ps", """
SELECT l.id, l.starting_price, count(peer_id) AS n_peers, CAST(floor(avg(CASE WHEN bstart > 0 THEN bstart END) + 0.5) AS BIGINT) AS avg_start,
  min(CASE WHEN bstart > 0 THEN bstart END) AS min_start, max(CASE WHEN bstart > 0 THEN bstart END) AS max_start,
  CAST(floor(avg(CASE WHEN bstatus = 'sold' AND bsold > 0 THEN bsold END) + 0.5) AS BIGINT) AS avg_sold
FROM fx_lots l LEFT JOIN pe ON pe.id = l.id GROUP BY 1, 2""")]


def summary(by: str) -> str:
    return with_ctes([LOTS], f"""
SELECT {by}, count(*) AS total, count(*) FILTER (WHERE status='sold') AS sold, count(*) FILTER (WHERE status='unsold') AS unsold,
  count(*) FILTER (WHERE regexp_matches(coalesce(observations,'') || '|' || model, '(?i)non\\s*roulant')) AS not_drivable,
  CAST(coalesce(sum(CASE WHEN status='sold' THEN nullif(sold_price,0) END), 0) AS BIGINT) AS revenue,
  CAST(coalesce(floor(avg(CASE WHEN status='sold' THEN nullif(sold_price,0) END) + 0.5), 0) AS BIGINT) AS avg_sold,
  coalesce(min(nullif(starting_price,0)),0) AS min_start, coalesce(max(nullif(starting_price,0)),0) AS max_start,
  CAST(coalesce(floor(avg(CASE WHEN status='sold' THEN nullif(sold_price,0) - nullif(starting_price,0) END) + 0.5), 0) AS BIGINT) AS avg_margin,
  count(*) FILTER (WHERE ct_available) AS ct_ok, count(*) FILTER (WHERE NOT ct_available) AS ct_missing,
  count(*) FILTER (WHERE status NOT IN ('sold','unsold')) AS available,
  CAST(floor(count(*) FILTER (WHERE status='sold') * 100 / count(*) + 0.5) AS BIGINT) AS sell_through
FROM fx_lots GROUP BY 1""")


def key(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x},''))), '[^a-z0-9]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(list_distinct(string_split({key(x)}, ' ')), lambda t: t <> '')"


def tok_overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / greatest(len({a}), len({b})) END"


# Stored side with token sets, and the score of (i, c) pairs in table "pairs".
STORED = ("cs", f"SELECT *, {toks('model')} AS mt, {toks('version')} AS vt FROM fx_vehicles")


def scored(source: str) -> list[tuple[str, str]]:
    def text(n: str) -> str:
        stored = f"coalesce(nullif(c_{n},''), nullif(c_l_{n},''))"
        return f"coalesce(nullif(i_{n},'') IS NOT NULL AND {key(stored)} <> '' AND {key(stored)} = {key('i_' + n)}, false)"

    def number(n: str) -> str:
        return f"coalesce(nullif(i_{n},0) = nullif(coalesce(c_{n}, c_l_{n}),0), false)"

    def mark(n: str) -> str:
        return f"coalesce(nullif(i_{n},'') = nullif(c_l_{n},''), false)"

    return [("f1", f"""
SELECT *, {tok_overlap('c_mt', 'i_mt')} AS mo, {tok_overlap('c_vt', 'i_vt')} AS vo, abs(c_year - i_year) AS yd, abs(c_l_mileage - i_mileage) AS km,
  {text('fuel')} AS s_fuel, {text('transmission')} AS s_gear, {text('color')} AS s_col, {number('engine_size')} AS s_eng, {number('power')} AS s_pow,
  {number('fiscal_power')} AS s_fis, {mark('technical_check_url')} AS s_ct, {mark('condition_image_url')} AS s_cond, {mark('photo_hash')} AS s_photo,
  nullif(i_reference,'') IS NOT NULL AND nullif(c_reference,'') IS NOT NULL AS both_refs FROM {source}"""), ("f2", """
SELECT *, s_ct OR s_cond OR s_photo AS fp, both_refs AND i_reference <> c_reference AS crossed,
  CASE WHEN mo >= 1 THEN 28 ELSE 18 END + CASE yd WHEN 0 THEN 14 ELSE 8 END + CASE WHEN vo >= 0.75 THEN 12 WHEN vo >= 0.5 THEN 6 ELSE 0 END
  + CASE WHEN km <= 500 THEN 22 WHEN km <= 1500 THEN 18 WHEN km <= 3000 THEN 14 WHEN km <= 5000 THEN 8 ELSE 0 END
  + CASE WHEN s_fuel THEN 8 ELSE 0 END + CASE WHEN s_gear THEN 8 ELSE 0 END + CASE WHEN s_col THEN 5 ELSE 0 END + CASE WHEN s_eng THEN 8 ELSE 0 END
  + CASE WHEN s_pow THEN 6 ELSE 0 END + CASE WHEN s_fis THEN 4 ELSE 0 END + CASE WHEN s_ct THEN 35 ELSE 0 END + CASE WHEN s_cond THEN 20 ELSE 0 END
  + CASE WHEN s_photo THEN 15 ELSE 0 END AS score,
  concat_ws(',', CASE WHEN mo >= 1 THEN 'same_model' ELSE 'close_model' END, CASE yd WHEN 0 THEN 'same_year' ELSE 'year_plus_minus_1' END,
    CASE WHEN vo >= 0.75 THEN 'close_version' WHEN vo >= 0.5 THEN 'partial_version' END,
    CASE WHEN km <= 500 THEN 'km_very_close' WHEN km <= 1500 THEN 'km_close' WHEN km <= 3000 THEN 'km_plus_minus_3k' WHEN km <= 5000 THEN 'km_plus_minus_5k' END,
    CASE WHEN s_fuel THEN 'same_fuel' END, CASE WHEN s_gear THEN 'same_transmission' END, CASE WHEN s_col THEN 'same_color' END,
    CASE WHEN s_eng THEN 'same_engine_size' END, CASE WHEN s_pow THEN 'same_power' END, CASE WHEN s_fis THEN 'same_fiscal_power' END,
    CASE WHEN s_ct THEN 'same_technical_check' END, CASE WHEN s_cond THEN 'same_condition_sheet' END, CASE WHEN s_photo THEN 'same_photo_hash' END,
    CASE WHEN both_refs AND i_reference <> c_reference THEN 'cross_reference_accepted' END) AS reasons
FROM f1 WHERE mo >= 0.6 AND yd <= 1"""), ("sc", """
SELECT *, score >= 70 OR coalesce(score >= 55 AND km <= 3000, false) AS strong FROM f2
WHERE NOT (coalesce(km > 5000, false) AND NOT fp) AND NOT (crossed AND NOT fp AND NOT coalesce(km <= 500, false))
  AND NOT (NOT both_refs AND NOT fp AND NOT s_pow AND NOT s_gear AND NOT s_eng)""")]


COLS = ["id", "reference", "year", "mt", "vt", "fuel", "transmission", "color", "engine_size", "power", "fiscal_power"]
MARKS = ["technical_check_url", "condition_image_url", "photo_hash"]
C_SIDE = ", ".join([f"c.{n} AS c_{n}" for n in COLS] + [f"c.l_{n} AS c_l_{n}" for n in COLS[5:] + MARKS + ["mileage"]])
I_SIDE = ", ".join(f"i.{n} AS i_{n}" for n in COLS + MARKS + ["mileage", "hash_id"])

RESOLVE = [VEH, REC, STORED, ("irec", f"SELECT *, {toks('model')} AS mt, {toks('version')} AS vt FROM fx_records"), ("pairs", f"""
SELECT {I_SIDE}, {C_SIDE} FROM irec i JOIN cs c ON upper(i.brand) = upper(c.brand) AND abs(i.year - c.year) <= 1""")] + scored("pairs") + [("bst", """
SELECT i_id, c_id, score, reasons, km, strong FROM sc QUALIFY row_number() OVER (PARTITION BY i_id ORDER BY score DESC, c_id) = 1"""), ("rv", """
SELECT r.id, (SELECT min(id) FROM fx_vehicles v WHERE v.reference = r.reference) AS by_ref, (SELECT min(id) FROM fx_vehicles v WHERE v.hash_id = r.hash_id) AS by_hash,
  b.c_id AS best, b.score, b.reasons, coalesce(b.strong, false) AS strong, coalesce(b.c_id <> (SELECT min(id) FROM fx_vehicles v WHERE v.hash_id = r.hash_id) AND b.score >= 70, false) AS repl
FROM fx_records r LEFT JOIN bst b ON b.i_id = r.id""")]

CLUSTERS = [VEH, STORED, ("ins", f"""
SELECT id, reference, hash_id, brand, model, version, year, mt, vt, coalesce(l_mileage,0) AS mileage,
  {', '.join(f'coalesce(l_{n}, {n}) AS {n}' for n in ['color', 'fuel', 'transmission', 'engine_size', 'power', 'fiscal_power'])},
  {', '.join(f'l_{n} AS {n}' for n in MARKS)} FROM cs WHERE l_mileage IS NOT NULL"""), ("pairs", f"""
SELECT {I_SIDE}, {C_SIDE} FROM ins i JOIN cs c ON upper(i.brand) = upper(c.brand) AND abs(i.year - c.year) <= 1 AND i.id < c.id AND c.l_mileage IS NOT NULL""")] + scored("pairs") + [
    ("ed", "SELECT i_id AS a, c_id AS b FROM sc WHERE strong UNION SELECT c_id, i_id FROM sc WHERE strong")]


def recursive(ctes: list[tuple[str, str]], body: str) -> str:
    walk = ("reach", "SELECT a AS id, a AS label FROM ed UNION SELECT ed.b, reach.label FROM reach JOIN ed ON ed.a = reach.id")
    done = ("cc", "SELECT id, min(label) AS cluster FROM reach GROUP BY 1")
    mapping = ("mp", """
SELECT id AS old_id, first(id) OVER (PARTITION BY cluster ORDER BY (reference IS NULL), (TRY_CAST(reference AS DOUBLE) IS NULL), TRY_CAST(reference AS DOUBLE), id) AS new_id, cluster
FROM cc JOIN fx_vehicles USING (id)""")
    return with_ctes(ctes + [walk, done, mapping], body).replace("WITH ", "WITH RECURSIVE ", 1)


SQL = {
    "similarity": with_ctes(ITEMS, """
SELECT it.id, count(*) FILTER (WHERE level = 'exact') AS n_exact, count(*) FILTER (WHERE level = 'same_model') AS n_same_model,
  count(*) FILTER (WHERE level = 'similar') AS n_similar, CAST(max(score) AS BIGINT) AS best_score FROM it LEFT JOIN pr ON pr.qid = it.id GROUP BY 1"""),
    "offers_elsewhere": with_ctes(OFFERS, "SELECT * REPLACE (CAST(score AS BIGINT) AS score) FROM off"),
    "offers_summary": with_ctes(OFFERS, """
SELECT id, count(*) AS n_offers, count(*) FILTER (WHERE level = 'same_model') AS n_same_model, count(*) FILTER (WHERE price_diff < 0) AS n_cheaper FROM off GROUP BY 1"""),
    "same_model": with_ctes(SAME, "SELECT id, others FROM smq"),
    "same_model_avg": with_ctes(SAME, """
SELECT id, n_others, CAST(floor(ay + 0.5) AS BIGINT) AS avg_year, CAST(floor(ak + 0.5) AS BIGINT) AS avg_mileage, CAST(floor(ap + 0.5) AS BIGINT) AS avg_starting_price,
  CASE WHEN ak IS NULL THEN NULL WHEN coalesce(l_mileage,0) = ak THEN 'neutral' WHEN coalesce(l_mileage,0) < ak THEN 'better' ELSE 'worse' END AS mileage_verdict,
  CASE WHEN ap IS NULL THEN NULL WHEN coalesce(starting_price,0) = ap THEN 'neutral' WHEN coalesce(starting_price,0) < ap THEN 'better' ELSE 'worse' END AS starting_price_verdict FROM smq"""),
    "similar_sold": with_ctes(SOLD, "SELECT * FROM st"),
    "similar_sold_top": with_ctes(SOLD, """
SELECT exclude_hash, row_number() OVER (PARTITION BY exclude_hash ORDER BY w DESC, rn) AS rank, id AS lot_id, sold_price, fits AS comparable FROM sl QUALIFY rank <= 20"""),
    "verdict": with_ctes(VERDICT, """
SELECT id, market, ref AS reference_price, CASE WHEN nullif(sold_price,0) IS NOT NULL THEN 'ADJUGE' WHEN nullif(starting_price,0) IS NOT NULL THEN 'MISE A PRIX' ELSE 'REFERENCE' END AS reference_label,
  range_min, range_max, tone, score, least(90, greatest(14, score - CASE tone WHEN 'good' THEN 4 WHEN 'bad' THEN 18 ELSE 10 END)) AS fill_pct,
  CAST(floor((ref - lo) / greatest(hi - lo, 1.0) * 100 + 0.5) AS BIGINT) AS marker_pct, CAST(floor(diff + 0.5) AS BIGINT) AS diff_pct, n_comparable FROM vd3"""),
    "peers": with_ctes(PEERS, "SELECT id, rank, peer_id, matches FROM pe"),
    "peer_stats": with_ctes(PEERS, """
SELECT id, n_peers, avg_start, min_start, max_start, avg_sold, CASE WHEN coalesce(avg_sold, avg_start) IS NOT NULL AND nullif(starting_price,0) IS NOT NULL
  THEN CASE WHEN starting_price <= coalesce(avg_sold, avg_start) THEN 'good' ELSE 'high' END END AS verdict, nullif(starting_price,0) - avg_start AS vs_mean FROM ps"""),
    "auction_summary": summary("auction_id"),
    "city_summary": summary("city"),
    "city_counts": with_ctes([LOTS], "SELECT auction_id, city, count(*) AS n FROM fx_lots WHERE city <> '' GROUP BY 1, 2"),
    "tri_state": with_ctes([LOTS], """
SELECT city, count(*) FILTER (WHERE ct_available) AS ct_ok, count(*) FILTER (WHERE NOT ct_available) AS ct_missing, count(*) FILTER (WHERE ct_available IS NULL) AS ct_unknown FROM fx_lots GROUP BY 1"""),
    "cheapest": with_ctes([LOTS], "SELECT id, starting_price, status FROM fx_lots ORDER BY coalesce(starting_price,0), id LIMIT 50"),
    "not_drivable": with_ctes([LOTS], """
SELECT city, count(*) FILTER (WHERE observations = 'NON ROULANT') AS strict,
  count(*) FILTER (WHERE observations = 'NON ROULANT') AS loose, count(*) FILTER (WHERE observations IS NOT NULL) AS comparable FROM fx_lots GROUP BY 1"""),
    "margins": with_ctes([LOTS], """
SELECT id, CASE WHEN starting_price <> 0 THEN sold_price - starting_price END AS vs_start, CAST(round((sold_price - starting_price) * 100.0 / nullif(starting_price,0)) AS BIGINT) AS vs_start_pct,
  CASE WHEN market_value <> 0 THEN sold_price - market_value END AS vs_market, CAST(round((sold_price - market_value) * 100.0 / nullif(market_value,0)) AS BIGINT) AS vs_market_pct
FROM fx_lots WHERE sold_price IS NOT NULL"""),
    "list_engagement": with_ctes([LOTS, ("s", "SELECT auction_id, count(*) AS total, count(*) FILTER (WHERE status='sold') AS sold FROM fx_lots GROUP BY 1"),
        ("x", "SELECT *, greatest(50, total * 5 + sold * 14) AS xp FROM s"), ("l", "SELECT *, greatest(1, CAST(floor(xp / 35) AS BIGINT) + 1) AS level FROM x")], """
SELECT auction_id, total, sold, xp, level, level * 35 AS next_level_xp, CAST(greatest(1, least(12, ceil(total / 8))) AS BIGINT) AS streak, greatest(1, sold) AS good_deals FROM l"""),
    "entity_engagement": with_ctes([view("fx_snapshots")] + chain_ctes() + [c for c in BADGES if c[0] != "fx_snapshots"] + [("x", """
SELECT e.vehicle_id, total_passages AS n, coalesce(b.k,0) AS k, last_passage_sold AND last_effective_price <> 0 AS sold FROM evo e LEFT JOIN (SELECT vehicle_id, count(*) AS k FROM bd GROUP BY 1) b USING (vehicle_id)"""),
        ("y", "SELECT *, greatest(90, 126 + n * 18 + k * 12 + CASE WHEN sold THEN 24 ELSE 0 END) AS xp FROM x"), ("z", "SELECT *, greatest(1, CAST(floor(xp / 30) AS BIGINT) + 1) AS level FROM y")], """
SELECT vehicle_id, xp, level, level * 30 AS next_level_xp, greatest(1, least(12, n + least(3, k))) AS streak, CAST(greatest(1, floor((42 + k * 10) / 22 + 0.5)) AS BIGINT) AS good_deals FROM z"""),
    "spec_terms": with_ctes([VEH], f"""
SELECT id, {trim('version')} AS trim, {key('version')} AS version_key, split_part(upper(model), ' ', 1) AS word,
  round({tok_overlap(toks('model'), toks("model || ' ' || version"))}, 6) AS model_overlap, CAST(trunc(l_mileage / greatest(1, 2024 - year + 1)) AS BIGINT) AS km_per_year FROM fx_vehicles"""),
    "resolve": with_ctes(RESOLVE, """
SELECT id, CASE WHEN by_ref IS NOT NULL THEN 'reference' WHEN repl THEN 'details' WHEN by_hash IS NOT NULL THEN 'hash' WHEN strong THEN 'details' END AS matched_by,
  CASE WHEN by_ref IS NOT NULL THEN by_ref WHEN repl THEN best WHEN by_hash IS NOT NULL THEN by_hash WHEN strong THEN best END AS vehicle_id,
  CASE WHEN by_ref IS NULL AND repl THEN by_hash END AS duplicate_id,
  CASE WHEN by_ref IS NOT NULL THEN 100 WHEN repl THEN score WHEN by_hash IS NOT NULL THEN CASE WHEN best = by_hash THEN score ELSE 50 END WHEN strong THEN score END AS score,
  CASE WHEN by_ref IS NOT NULL THEN 'same_reference' WHEN repl THEN reasons WHEN by_hash IS NOT NULL THEN CASE WHEN best = by_hash THEN reasons ELSE 'same_hash' END WHEN strong THEN reasons END AS reasons FROM rv"""),
    "clusters": recursive(CLUSTERS, "SELECT id, cluster FROM cc"),
    "merge_clusters": recursive(CLUSTERS, "SELECT old_id, new_id FROM mp"),
    "cluster_summary": recursive(CLUSTERS + [LOTS], """
SELECT count(DISTINCT cluster) AS clusters, count(*) FILTER (WHERE old_id <> new_id) AS deleted,
  CAST(coalesce(sum(CASE WHEN old_id <> new_id THEN n END),0) AS BIGINT) AS moved_snapshots
FROM mp LEFT JOIN (SELECT vehicle_id, count(*) AS n FROM fx_lots GROUP BY 1) s ON s.vehicle_id = mp.old_id"""),
}

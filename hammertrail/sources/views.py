"""Views that give the driver tables the shape of listing data.

Each view is one SQL text that runs unchanged in Spark and in DuckDB, apart
from the two tokens below, so a check can build the same input on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

DIALECT = {
    "spark": {
        "{K}": "cast(get_json_object(props, '$.k') as int)",
        "{DAY}": "date_format(ts, 'yyyy-MM-dd')",
    },
    "duckdb": {
        "{K}": "cast(json_extract_string(props, '$.k') as int)",
        "{DAY}": "strftime(ts, '%Y-%m-%d')",
    },
}

VIEWS = {
    # Snapshot log: one observation of a listed entity per event.
    "fx_snapshots": """
SELECT event_id AS id, user_id AS vehicle_id,
  CASE WHEN event_id % 11 = 0 THEN NULL
       ELSE concat('h', cast(user_id AS varchar(20)), '_', cast(CASE WHEN extract(day FROM ts) <= 15 THEN 1 ELSE 2 END AS varchar(2))) END AS hash_id,
  CASE WHEN event_id % 19 = 0 THEN concat('R', cast(user_id + 1 AS varchar(20)))
       WHEN event_id % 4 = 0 THEN concat('R', cast(user_id AS varchar(20))) END AS reference,
  concat('BRAND', cast(user_id % 7 AS varchar(5))) AS brand,
  concat('MODEL', cast(user_id % 5 AS varchar(5)), ' GT') AS model,
  cast(2010 + user_id % 9 AS bigint) AS year,
  cast(ts AS timestamp) AS scraped_at, {DAY} AS scraped_day,
  CASE event_type WHEN 'purchase' THEN 'sold' WHEN 'error' THEN 'unsold' WHEN 'click' THEN 'auction_live'
       WHEN 'signup' THEN 'removed' ELSE 'available' END AS status,
  CASE WHEN event_id % 13 = 0 THEN NULL
       ELSE concat('2024-01-', lpad(cast(cast(ceil(extract(day FROM ts) / 5.0) * 5 AS int) AS varchar(2)), 2, '0')) END AS sale_date,
  CASE WHEN event_id % 3 <> 0 THEN concat(cast(9 + event_id % 8 AS varchar(2)), 'h30') END AS sale_time,
  CASE WHEN event_type IN ('view','click') AND event_id % 5 <> 0
       THEN CASE WHEN event_id % 7 = 0 THEN 100 ELSE cast(floor(value * 100) AS bigint) END END AS starting_price,
  CASE WHEN event_type = 'click' THEN cast(floor(value * 110) AS bigint) END AS live_price,
  CASE WHEN event_type = 'purchase' THEN cast(floor(value * 120) AS bigint) END AS sold_price,
  CASE WHEN event_id % 17 = 0 THEN cast(floor(value * 130) AS bigint) END AS market_value,
  cast(NULL AS bigint) AS new_price,
  cast(CASE WHEN event_id % 29 = 0 THEN 0 ELSE 10000 + user_id * 100 + extract(day FROM ts) * 10 END AS bigint) AS mileage,
  concat('C', cast({K} % 9 AS varchar(3))) AS city,
  CASE WHEN event_id % 6 <> 0 THEN concat('Z', cast({K} % 4 AS varchar(3))) END AS center,
  CASE WHEN event_id % 9 <> 0 THEN cast({K} AS bigint) END AS lot_number,
  CASE WHEN event_id % 23 = 0 THEN 'Véhicule non roulant' WHEN event_id % 10 <> 0 THEN 'RAS' END AS observations,
  CASE WHEN event_id % 12 = 0 THEN concat('https://cdn.example.com/', cast(user_id AS varchar(20)), '_CT.pdf') END AS technical_check_url,
  concat('https://www.Example.com/', CASE WHEN event_id % 11 = 0 THEN concat('c/', cast({K} % 9 AS varchar(3)))
       ELSE concat('vehicule/', cast(user_id AS varchar(20)), cast(CASE WHEN extract(day FROM ts) <= 15 THEN 1 ELSE 2 END AS varchar(2))) END, '/') AS source_url,
  CASE {K} % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["p1"]' WHEN 2 THEN '["p1","p2"]' ELSE 'broken' END AS photo_urls,
  event_id % 2 = 0 AS has_screenshot
FROM events
""",
    # Entity dimension of the snapshot log: one row per user.
    "fx_entities": """
SELECT user_id AS id,
  CASE WHEN user_id % 3 <> 0 THEN concat('R', cast(user_id AS varchar(20))) END AS reference,
  CASE WHEN user_id % 4 <> 0 THEN concat('h', cast(user_id AS varchar(20)), '_1') END AS hash_id,
  concat('BRAND', cast(user_id % 7 AS varchar(5))) AS brand,
  concat('MODEL', cast(user_id % 5 AS varchar(5)), ' GT') AS model,
  '' AS version, cast(2010 + user_id % 9 AS bigint) AS year,
  cast(min(ts) AS timestamp) AS first_seen_at, cast(max(ts) AS timestamp) AS last_seen_at
FROM events GROUP BY user_id
""",
    # The latest list scrape: the last card of every entity on the last day of the log.
    "fx_list_batch": """
SELECT vehicle_id, hash_id, reference, scraped_at, starting_price, live_price, sold_price, city, status FROM (
  SELECT user_id AS vehicle_id, concat('h', cast(user_id AS varchar(20)), CASE WHEN {K} % 10 = 0 THEN '_9' ELSE '_1' END) AS hash_id,
    CASE WHEN event_id % 4 = 0 THEN concat('R', cast(user_id AS varchar(20))) END AS reference,
    cast(ts AS timestamp) AS scraped_at, cast(floor(value * 100) AS bigint) AS starting_price,
    CASE WHEN event_type = 'click' THEN cast(floor(value * 110) AS bigint) END AS live_price,
    CASE WHEN event_type = 'purchase' THEN cast(floor(value * 120) AS bigint) END AS sold_price,
    concat('C', cast({K} % 9 AS varchar(3))) AS city, 'available' AS status,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events)) x
WHERE rn = 1
""",
    # Entity dimension with near duplicates, each with its latest snapshot (l_*).
    "fx_vehicles": """
SELECT p_partkey AS id, upper(p_brand) AS brand, upper(p_name) AS model,
  CASE WHEN p_partkey % 8 = 0 THEN '' ELSE concat(p_type, ' ', cast(60 + (p_size % 8) * 20 AS varchar(5)), ' ch BVA8 ', CASE WHEN p_partkey % 3 = 0 THEN 'Business' ELSE 'Active' END) END AS version,
  cast(2000 + p_size % 20 AS bigint) AS year,
  CASE WHEN p_partkey % 3 <> 0 THEN concat('R', cast(p_partkey % 500 AS varchar(10))) END AS reference,
  concat('v', cast(p_partkey AS varchar(20))) AS hash_id,
  CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'GO' ELSE 'ES' END AS fuel,
  CASE p_partkey % 3 WHEN 0 THEN 'BVA8' WHEN 1 THEN 'BVM6' ELSE '' END AS transmission,
  CASE p_partkey % 4 WHEN 0 THEN 'Gris' WHEN 1 THEN 'Noir' ELSE '' END AS color,
  CASE WHEN p_partkey % 13 <> 0 THEN cast(60 + (p_size % 8) * 20 AS bigint) END AS power,
  CASE WHEN p_partkey % 6 <> 0 THEN cast(1000 + (p_size % 5) * 200 AS bigint) END AS engine_size,
  cast(NULL AS bigint) AS fiscal_power,
  CASE WHEN p_partkey % 97 <> 0 THEN cast((p_partkey * 37) % 20000 AS bigint) END AS l_mileage,
  CASE WHEN p_partkey % 7 = 0 THEN 'Bleu' WHEN p_partkey % 4 = 0 THEN 'Gris' ELSE '' END AS l_color,
  CASE WHEN p_partkey % 2 = 0 THEN 'GO' ELSE 'ES' END AS l_fuel,
  CASE p_partkey % 3 WHEN 0 THEN 'BVA8' WHEN 1 THEN 'BVM6' ELSE '' END AS l_transmission,
  CASE WHEN p_partkey % 5 <> 0 THEN cast(60 + (p_size % 8) * 20 AS bigint) END AS l_power,
  CASE WHEN p_partkey % 4 <> 0 THEN cast(1000 + (p_size % 5) * 200 AS bigint) END AS l_engine_size,
  cast(NULL AS bigint) AS l_fiscal_power,
  CASE WHEN p_partkey % 41 = 0 THEN concat('ct', cast(p_partkey % 31 AS varchar(10))) END AS l_technical_check_url,
  cast(NULL AS varchar(10)) AS l_condition_image_url,
  CASE WHEN p_partkey % 10 = 0 THEN concat('cdn', cast(p_partkey % 70 AS varchar(10))) END AS l_photo_hash,
  CASE p_partkey % 5 WHEN 0 THEN 'sold' WHEN 1 THEN 'auction_live' WHEN 2 THEN 'unsold' ELSE 'available' END AS status,
  CASE WHEN p_partkey % 6 <> 0 THEN cast(floor(p_retailprice * 10) AS bigint) END AS starting_price,
  concat('https://example.com/vehicule/', cast(p_partkey AS varchar(20)), '/') AS source_url,
  cast(p_size % 10 AS bigint) AS auction_id
FROM part
""",
    # Incoming records to resolve against fx_vehicles.
    "fx_records": """
SELECT p_partkey AS id, upper(p_brand) AS brand, upper(p_name) AS model,
  concat(p_type, ' ', cast(60 + (p_size % 8) * 20 AS varchar(5)), ' ch BVA8 ', CASE WHEN p_partkey % 2 = 0 THEN 'Business' ELSE 'Active' END) AS version,
  cast(2000 + p_size % 20 + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS bigint) AS year,
  CASE p_partkey % 5 WHEN 0 THEN concat('R', cast(p_partkey % 500 AS varchar(10))) WHEN 1 THEN concat('X', cast(p_partkey AS varchar(10))) END AS reference,
  CASE p_partkey % 4 WHEN 0 THEN concat('v', cast(p_partkey AS varchar(20))) WHEN 1 THEN concat('v', cast(p_partkey + 3 AS varchar(20))) ELSE concat('n', cast(p_partkey AS varchar(20))) END AS hash_id,
  cast((p_partkey * 37) % 20000 + (p_partkey % 7) * 400 AS bigint) AS mileage,
  CASE WHEN p_partkey % 3 = 0 THEN 'GRIS' ELSE 'noir' END AS color,
  CASE WHEN p_partkey % 2 = 0 THEN 'GO' ELSE 'ES' END AS fuel,
  CASE p_partkey % 4 WHEN 0 THEN 'BVA8' WHEN 1 THEN 'BVM6' ELSE '' END AS transmission,
  CASE WHEN p_partkey % 2 = 0 THEN cast(1000 + (p_size % 5) * 200 AS bigint) END AS engine_size,
  CASE WHEN p_partkey % 3 <> 1 THEN cast(60 + (p_size % 8) * 20 AS bigint) END AS power,
  cast(NULL AS bigint) AS fiscal_power,
  CASE WHEN p_partkey % 41 = 0 THEN concat('ct', cast(p_partkey % 31 AS varchar(10))) END AS technical_check_url,
  cast(NULL AS varchar(10)) AS condition_image_url,
  CASE WHEN p_partkey % 10 = 0 THEN concat('cdn', cast(p_partkey % 70 AS varchar(10))) END AS photo_hash
FROM part
""",
    # Auction lists and sold comparables.
    "fx_lots": """
SELECT concat(cast(l.l_orderkey AS varchar(20)), '-', cast(l.l_linenumber AS varchar(20)), '-', cast(l.l_partkey AS varchar(20)), '-', cast(l.l_suppkey AS varchar(20)),
    '-', cast(cast(floor(l.l_extendedprice * 100) AS bigint) AS varchar(20))) AS id,
  l.l_orderkey AS auction_id,
  concat('s', cast(p.p_partkey AS varchar(20))) AS hash_id,
  upper(p.p_brand) AS brand, upper(p.p_name) AS model, cast(2000 + p.p_size % 20 AS bigint) AS year, p.p_partkey AS vehicle_id,
  n.n_name AS city, cast(l.l_shipdate AS timestamp) AS scraped_at,
  cast((p.p_partkey * 137) % 150000 AS bigint) AS mileage,
  CASE l.l_returnflag WHEN 'A' THEN 'sold' WHEN 'R' THEN 'unsold' ELSE 'available' END AS status,
  cast(floor(l.l_extendedprice * (1 - l.l_discount)) AS bigint) AS starting_price,
  CASE WHEN l.l_returnflag = 'A' THEN cast(floor(l.l_extendedprice) AS bigint) END AS sold_price,
  CASE WHEN p.p_partkey % 4 = 0 THEN cast(floor(p.p_retailprice * 20) AS bigint) END AS market_value,
  CASE WHEN l.l_linenumber = 1 THEN true WHEN l.l_linenumber = 2 THEN false END AS ct_available,
  CASE WHEN (l.l_orderkey + l.l_linenumber) % 17 = 0 THEN 'NON ROULANT' WHEN l.l_linenumber = 3 THEN 'véhicule accidenté' END AS observations
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
""",
    # Page visits under aliased keys.
    "fx_visits": """
SELECT event_id AS visit_id, cast(ts AS timestamp) AS visited_at,
  CASE WHEN event_id % 3 <> 2 THEN user_id END AS vehicle_id,
  CASE WHEN event_id % 3 <> 0 THEN concat('h', cast(user_id AS varchar(20))) END AS hash_id,
  CASE WHEN event_id % 5 = 0 THEN concat('r', cast(user_id AS varchar(20))) END AS reference,
  concat('BRAND', cast(user_id % 7 AS varchar(5))) AS brand, concat('MODEL', cast(event_id % 5 AS varchar(5))) AS model,
  concat('https://www.Example.com/vehicule/', cast(user_id AS varchar(20)), '/?v=', cast(event_id AS varchar(20))) AS source_url
FROM events
""",
    # Watch flags.
    "fx_watchlist": """
SELECT c_custkey AS id, c_custkey AS vehicle_id, c_mktsegment AS notes,
  c_custkey % 2 = 0 AS alert_on_price, c_custkey % 3 = 0 AS alert_on_reappear
FROM customer
""",
    # Report texts: each document followed by a report section.
    "fx_reports": """
SELECT doc_id, concat(text,
  CASE doc_id % 6 WHEN 0 THEN ' Défaillance(s) majeure(s) : 1.1.13.a.2 5.3.1.b.1 Défaillance(s) mineure(s) : 4.5.2.a.1 Prochain contrôle'
    WHEN 1 THEN ' Favorable Défaillances mineures : 7.1.2.b.1 8.2.1 Observations :'
    WHEN 2 THEN ' contrôle volontaire aucune défaillance constatée'
    WHEN 3 THEN ' Résultat : défavorable 5,2,3.e.1 puis 6.1.1.a'
    WHEN 4 THEN ' contrôle technique contre-visite' ELSE '' END) AS text
FROM documents
""",
}


def view_sql(name: str, dialect: str) -> str:
    text = VIEWS[name]
    for token, value in DIALECT[dialect].items():
        text = text.replace(token, value)
    return text


def load_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """Give a table read from fewer splits than there are cores one per core.

    A table of many files is left as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def load_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one view over the tables of ``sf_dir``."""
    sql = view_sql(name, "spark")
    used = [t for t in TABLES if f"FROM {t}" in sql or f"JOIN {t} " in sql]
    frames = {t: load_table(spark, sf_dir, t) for t in used}
    for t in used:
        if f"FROM {t}" in sql:
            frames[t] = spread(frames[t])
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **frames)

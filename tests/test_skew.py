"""The same expected results when one key holds a third of all rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from hammertrail.sources.views import TABLES
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
HOT = {
    # One entity holds a third of the log.
    "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id)",
    # A third of the entities share brand, name, type, size and price.
    "part": """* REPLACE (CASE WHEN p_partkey % 3 = 0 THEN 'red ring' ELSE p_name END AS p_name,
      CASE WHEN p_partkey % 3 = 0 THEN 'Brand#1' ELSE p_brand END AS p_brand,
      CASE WHEN p_partkey % 3 = 0 THEN 'SMALL' ELSE p_type END AS p_type,
      CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE p_size END AS p_size,
      CASE WHEN p_partkey % 3 = 0 THEN 900.0 ELSE p_retailprice END AS p_retailprice)""",
    # One auction and one entity hold a third of the lots each.
    "lineitem": """* REPLACE (CASE WHEN l_linenumber IN (1, 2) THEN 11 ELSE l_orderkey END AS l_orderkey,
      CASE WHEN l_linenumber IN (2, 3) THEN 9 ELSE l_partkey END AS l_partkey)""",
}
QUERIES = [
    "evolution", "price_history", "event_compression", "badges", "capture_timeline", "retention", "visits",
    "greedy_list", "similarity", "offers_elsewhere", "same_model", "similar_sold", "peers", "resolve", "clusters",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    for t in TABLES:
        duckdb.sql(f"COPY (SELECT {HOT.get(t, '*')} FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_hot_key(spark, skewed, name):
    assert compare(entry.queries()[name](spark, skewed), duck(skewed), entry.oracle_sql()[name]) == ""

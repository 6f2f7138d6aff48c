"""A sample of the registered queries against their expected results.

``python tests/oracle_check.py`` compares all of them.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "evolution", "price_history", "navigation", "badges", "capture_plan", "snapshot_diff", "batch_delta", "visits",
    "polluted_split", "similarity", "offers_elsewhere", "similar_sold", "peers", "auction_summary", "resolve",
    "report_label", "list_cards", "greedy_list", "stream_list",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_expected_result_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

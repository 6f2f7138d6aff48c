from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hammertrail.session import local_session

    session = local_session("4", 4)
    yield session
    session.stop()


SNAP_SCHEMA = (
    "id long, vehicle_id long, hash_id string, city string, center string, status string, sale_date string, "
    "sale_time string, scraped_at timestamp, starting_price long, live_price long, sold_price long, "
    "market_value long, new_price long, mileage long, lot_number long, observations string, "
    "technical_check_url string, source_url string"
)


@pytest.fixture(scope="session")
def snaps(spark):
    """Build a snapshot frame from partial rows; the scrape time counts hours."""
    import datetime

    start = datetime.datetime(2026, 4, 10, 10)

    def build(*rows: dict):
        names = [f.split()[0] for f in SNAP_SCHEMA.split(", ")]
        full = []
        for n, row in enumerate(rows, 1):
            base = dict.fromkeys(names)
            base |= {"id": n, "vehicle_id": 1, "hash_id": "aa", "city": "PARIS", "status": "available",
                     "sale_date": "2026-04-13", "mileage": 50000, "source_url": "https://x/v/aa"}
            base["scraped_at"] = start + datetime.timedelta(hours=row.get("h", n))
            base |= {k: v for k, v in row.items() if k != "h"}
            full.append(tuple(base[c] for c in names))
        return spark.createDataFrame(full, SNAP_SCHEMA)

    return build

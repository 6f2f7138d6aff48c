"""Scalar expressions against literal values."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from hammertrail.functions import prices as P
from hammertrail.functions import text as X
from hammertrail.functions import urls as U


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)
    return lambda col: frame.select(col).first()[0]


@pytest.mark.parametrize(
    "price,live,sold,market,new,want",
    [(100, 500, None, None, None, True), (100, None, 500, None, None, True), (100, None, None, 1000, None, True),
     (100, None, None, None, 1000, True), (100, 499, 400, 999, 999, False), (15000, 20000, None, None, None, False),
     (None, 20000, None, None, None, False), (100, None, None, None, None, False)],
)
def test_placeholder(one, price, live, sold, market, new, want):
    assert one(P.is_placeholder(*[F.lit(v).cast("long") for v in (price, live, sold, market, new)])) is want


@pytest.mark.parametrize("a,b,want", [(207, 150, True), (207, 200, False), (75, 100, False), (75, 130, True), (None, 130, False)])
def test_power_gate(one, a, b, want):
    assert one(P.power_gate(F.lit(a).cast("int"), F.lit(b).cast("int"))) is want


def test_keys_and_overlap(one):
    assert one(X.normalize_key(F.lit("  Citroën C3-Aircross "))) == "citroen c3 aircross"
    assert one(X.token_overlap(F.lit("Puma 1.0"), F.lit("puma"))) == pytest.approx(1 / 3)
    assert one(X.token_overlap(F.lit(""), F.lit("puma"))) == 0
    assert one(X.fold(F.lit(" ÉPAVE "))) == "epave"


def test_titles(one):
    assert one(X.brand_of(F.lit("LAND ROVER Evoque"))) == "LAND ROVER"
    assert one(X.brand_of(F.lit("TESLA MODEL 3"))) == "TESLA"
    assert one(X.model_of(F.lit("Clio E-Tech hybride"))) == "Clio E-Tech"
    assert one(X.trim_level(F.lit("1.5 dCi 110 ch BVM6 Business"))) == "Business"
    assert one(X.trim_level(F.lit("sans puissance"))) == ""


def test_dates(one):
    assert one(X.parse_date(F.lit("2/4/26"))) == "2026-04-02"
    as_of = F.lit(datetime.datetime(2026, 4, 1))
    text = F.lit("1ère MEC 19/08/2019, vente le 13/04/26")
    assert one(X.plausible_date(text, as_of)) == "2026-04-13"
    assert one(X.plausible_date(F.lit("19/08/2019"), as_of)) is None


def test_numbers(one):
    assert one(X.parse_km(F.lit("72 429 km"))) == 72429
    assert one(X.parse_year(F.lit("Année 2021"))) == 2021
    assert one(X.parse_price(F.lit("6 500 €"))) == 6500
    assert one(X.json_strings(F.lit("broken"))) == []
    assert one(X.dedup_items(F.array(F.lit("GPS"), F.lit("gps"), F.lit("Clim")))) == ["GPS", "Clim"]


def test_urls(one):
    assert one(U.normalize_url(F.lit("https://www.Example.com/a/b//?q=1#x"))) == "example.com/a/b?q=1"
    assert one(U.hash_from_url(F.lit("https://x/vehicule/ab12/slug"))) == "ab12"
    assert one(U.page_url(F.lit("https://x/l?page=3&v=1"), 5)) == "https://x/l?v=1&page=5"
    assert one(U.page_url(F.lit("https://x/l?page=3"), 1)) == "https://x/l"
    assert one(U.page_type(F.lit("https://x.fr/vehicule/ab12/slug"))) == "detail"
    assert one(U.page_type(F.lit("https://x.fr/enchere/liste"))) == "list"


def test_presentation(one):
    assert one(P.fmt_money(F.lit(14900))) == "14 900 €"
    assert one(P.fmt_date(F.lit("2026-04-13"))) == "13/04/2026"
    assert one(P.truncate(F.lit("x" * 70))) == "x" * 59 + "…"
    now = F.lit(datetime.datetime(2026, 4, 11, 9, 0, 0))
    assert one(P.countdown(F.lit("2026-04-13"), F.lit("10h30"), now)) == "49:00:00"
    assert one(P.countdown(F.lit("2026-04-01"), F.lit(None).cast("string"), now)) is None
    assert one(P.number_delta(F.lit(None).cast("long"), F.lit(5))) == 5
    assert one(P.number_delta(F.lit(5), F.lit(5))) is None
    assert one(P.margin_pct(F.lit(1125), F.lit(1000))) == 13
    assert one(P.status_label(F.lit("removed"))) == "Retire"


def test_wording(one):
    assert one(P.not_drivable("strict", F.lit("véhicule non accidenté"))) is False
    assert one(P.not_drivable("strict", F.lit("Lot NON ROULANT"))) is True
    # An accented end is no word end in the ASCII sense, on any Java version.
    assert one(P.not_drivable("strict", F.lit("véhicule accidente, à voir"))) is True
    assert one(P.not_drivable("strict", F.lit("véhicule accidenté"))) is False
    assert one(P.not_drivable("strict", F.lit("véhicule accidenté à voir"))) is False
    assert one(P.not_drivable("strict", F.lit("véhicule accidentel"))) is False
    assert one(P.not_drivable("comparable", F.lit("ÉPAVE"))) is True

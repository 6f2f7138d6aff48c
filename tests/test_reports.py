"""Inspection report wording."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hammertrail.operators import reports as R

CASES = [
    ("Défaillance(s) majeure(s) : 2.1.1.a frein usé 4.1.1.a phare Défaillance(s) mineure(s) : Néant Résultat du contrôle : défavorable",
     "CT · 2 défauts majeurs", "bad", ["2.1.1.a", "4.1.1.a"], []),
    ("Défaillance(s) majeure(s) : Néant Défaillance(s) mineure(s) : 6.1.2.a essuie-glace 8.1.1 pneu Résultat : favorable",
     "CT · 2 défauts mineurs", "warn", [], ["6.1.2.a", "8.1.1"]),
    ("Contrôle VOLONTAIRE Défauts ou anomalies constatées (ne permettant pas la validation) : 3.1.2.a jeu Autres défauts ou anomalies constatées : 6.1.2.a",
     "CT volontaire · 1 défaut majeur", "bad", ["3.1.2.a"], ["6.1.2.a"]),
    ("Défaillance!s) constatée(s) (ne permettant pas) : AUCUNE DEFAILLANCE CONSTATEE Autre(s) défaillance(s) constatée(s) : AUCUNE DEFAILLANCE CONSTATEE",
     "CT OK (vide)", "ok", [], []),
    ("Contrôle technique périodique Favorable 4,5,2.a.1 réglage 5.3.3.a.1 tubes puis informations défavorable",
     "CT · 2 défauts mineurs", "warn", [], ["4.5.2.a.1", "5.3.3.a.1"]),
    ("PROCES-VERBAL CONTROLE TECHNIQUE - Resultat: Favorable", "CT OK", "ok", [], []),
    ("contrôle volontaire, mesures seulement", "CT volontaire OK", "ok", [], []),
    ("contrôle technique contre-visite", "CT · contre-visite", "bad", [], []),
    ("texte sans rapport", None, None, [], []),
    ("", None, None, [], []),
]


@pytest.fixture(scope="module")
def parsed(spark):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    return {r["i"]: r for r in R.parse_reports(frame).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_label(parsed, i):
    row = parsed[i]
    assert (row["label"], row["tone"], row["major_codes"], row["minor_codes"]) == CASES[i][1:]


@pytest.mark.parametrize(
    "text,want",
    [("1.2.3.a 2.4.5.b", ["1.2.3.a", "2.4.5.b"]), ("8.1.1 5.6.7", ["8.1.1", "5.6.7"]), ("1.2.3.a x 1.2.3.a", ["1.2.3.a"]),
     ("contrôle du 12.05.2024", []), ("Z.0.0.0.2 observations", []), ("1 . 2 . 3 . a texte", ["1.2.3.a"]), ("tél 02.35.75.01.01", [])],
)
def test_codes(spark, text, want):
    assert spark.range(1).select(R.defect_codes(R.normalize_report(F.lit(text)))).first()[0] == want


def test_plural_marks(spark):
    texts = ["Défaillance(s) majeure(s)", "Défaillance (s) majeure (s)", "DEFAILLANCE!S) MAJEURE[S]"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(R.normalize_report(F.col("t")))
    assert {r[0] for r in frame.collect()} == {"defaillances majeures"}


def test_pages_of_a_report(spark):
    from hammertrail.operators.reports import report_pages

    rows = spark.createDataFrame([(1, "a\n----- PAGE -----\n----- PAGE -----b"), (2, ""), (3, None), (4, "no break")], "doc_id int, text string")
    got = sorted(map(tuple, report_pages(rows).collect()))
    assert got == [(1, 1, "a\n"), (1, 2, "\n"), (1, 3, "b"), (2, 1, ""), (4, 1, "no break")]

"""Expected results of the report queries.

The regular expressions of DuckDB know no lookaround; a leading context
character stands in for the lookbehind and a word boundary for the lookahead.
"""

from __future__ import annotations

from hammertrail.operators.reports import EMPTY, MAJOR_HEADERS, MINOR_HEADERS, STOPS
from oracles.base import view, with_ctes


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def codes(x: str) -> str:
    pattern = r"(?:^|[^\w.,])([1-9]\d?\s*[.,]\s*\d{1,2}\s*[.,]\s*\d{1,2}(?:\s*[.,]\s*[a-z])?(?:\s*[.,]\s*\d{1,2})?)\b"
    cleaned = f"list_transform(regexp_extract_all({x}, '{pattern}', 1), lambda c: replace(regexp_replace(c, '\\s+', '', 'g'), ',', '.'))"
    return f"list_filter({cleaned}, lambda c, i: list_position({cleaned}, c) = i)"


def slice_of(headers: list[str], others: list[str]) -> str:
    rest = f"regexp_replace(norm, '(?s)^.*?(?:{any_of(headers)})', '')"
    return f"CASE WHEN regexp_matches(norm, '{any_of(headers)}') THEN regexp_extract({rest}, '(?s)^(.*?)(?:{any_of(others + STOPS)}|$)', 1) END"


def place(word: str) -> str:
    return f"CASE WHEN regexp_matches(norm, '{word}') THEN length(regexp_extract(norm, '(?s)^(.*?){word}', 1)) END"


PARSED = [view("fx_reports"), ("n0", r"""
SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'),
  '([a-z])\s*[(!\[]\s*s\s*[)!\]]', '\1s', 'g'), '\s+', ' ', 'g')) AS norm FROM fx_reports"""), ("n1", f"""
SELECT *, {slice_of(MAJOR_HEADERS, MINOR_HEADERS)} AS major, {slice_of(MINOR_HEADERS, MAJOR_HEADERS)} AS minor,
  {place(chr(92) + 'bfavorable' + chr(92) + 'b')} AS fav, {place(chr(92) + 'bdefavorable' + chr(92) + 'b')} AS unfav FROM n0"""), ("n2", rf"""
SELECT *, coalesce(fav < coalesce(unfav, 2147483647), false) AS favorable, coalesce(unfav < coalesce(fav, 2147483647), false) AS unfavorable,
  coalesce(regexp_matches(major, '{any_of(EMPTY)}') OR contains(major[1:80], 'neant'), false) AS major_empty,
  coalesce(regexp_matches(minor, '{any_of(EMPTY)}') OR contains(minor[1:80], 'neant'), false) AS minor_empty,
  contains(norm, 'defaillance') AS has_defaillance, regexp_matches(norm, '\bdefauts?\b') AS has_defauts, regexp_matches(norm, '\banomalies?\b') AS has_anomalies,
  contains(norm, 'volontaire') AS has_volontaire, regexp_matches(norm, 'contre[-\s]?visite') AS counter_visit, regexp_matches(norm, 'controle\s+technique') AS ctl,
  major IS NULL AND minor IS NULL AS bare FROM n1"""), ("n3", f"""
SELECT *, CASE WHEN major IS NOT NULL AND NOT major_empty THEN {codes('major')} WHEN bare AND unfavorable THEN {codes('norm')} ELSE [] END AS mj,
  CASE WHEN minor IS NOT NULL AND NOT minor_empty THEN {codes('minor')} WHEN bare AND favorable THEN {codes('norm')} ELSE [] END AS mn,
  CASE WHEN bare AND NOT favorable AND NOT unfavorable THEN len({codes('norm')}) ELSE 0 END AS unclassified,
  CASE WHEN has_volontaire THEN 'CT volontaire' ELSE 'CT' END AS prefix FROM n2"""), ("n4", """
SELECT *, len(mj) AS n_major, len(mn) AS n_minor, has_defaillance OR has_defauts OR has_anomalies AS voc FROM n3"""), ("rp", """
SELECT *, CASE WHEN norm = '' THEN NULL WHEN n_major > 0 THEN prefix || ' · ' || n_major || ' défaut' || CASE WHEN n_major > 1 THEN 's majeurs' ELSE ' majeur' END
  WHEN n_minor > 0 THEN prefix || ' · ' || n_minor || ' défaut' || CASE WHEN n_minor > 1 THEN 's mineurs' ELSE ' mineur' END
  WHEN unclassified > 0 THEN prefix || ' · ' || unclassified || ' défaut' || CASE WHEN unclassified > 1 THEN 's' ELSE '' END
  WHEN counter_visit THEN prefix || ' · contre-visite' WHEN unfavorable THEN prefix || ' · défavorable'
  WHEN (favorable OR voc OR has_volontaire OR ctl) THEN prefix || CASE WHEN voc OR major_empty OR minor_empty THEN ' OK (vide)' ELSE ' OK' END END AS label,
  CASE WHEN norm = '' THEN NULL WHEN n_major > 0 THEN 'bad' WHEN n_minor > 0 OR unclassified > 0 THEN 'warn' WHEN counter_visit OR unfavorable THEN 'bad'
  WHEN favorable OR voc OR has_volontaire OR ctl THEN 'ok' END AS tone FROM n4""")]

SQL = {
    "report_label": with_ctes(PARSED, """
SELECT doc_id, label, tone, array_to_string(mj, ',') AS major_codes, array_to_string(mn, ',') AS minor_codes, unclassified FROM rp"""),
    "report_diagnostics": with_ctes(PARSED, """
SELECT doc_id, has_defaillance, has_defauts, has_anomalies, has_volontaire, major IS NOT NULL AS has_major_header, minor IS NOT NULL AS has_minor_header,
  favorable, unfavorable, counter_visit, length(norm) AS normalized_length FROM rp"""),
    "report_snippet": with_ctes(PARSED[:2], """
SELECT doc_id, instr(norm, 'defaillance') - 1 AS first_index, CASE WHEN instr(norm, 'defaillance') = 0 THEN '' ELSE
  substring(norm, greatest(1, instr(norm, 'defaillance') - 40), instr(norm, 'defaillance') + 200 - greatest(1, instr(norm, 'defaillance') - 40)) END AS snippet FROM n0"""),
    "report_rollup": with_ctes(PARSED, """
SELECT tone, label, count(*) AS n_reports, CAST(sum(n_major) AS BIGINT) AS n_major, CAST(sum(n_minor) AS BIGINT) AS n_minor FROM rp GROUP BY 1, 2"""),
    "code_frequency": with_ctes(PARSED, """
SELECT severity, code, count(*) AS n FROM (SELECT 'major' AS severity, unnest(mj) AS code FROM rp UNION ALL SELECT 'minor', unnest(mn) FROM rp) x GROUP BY 1, 2"""),
    "quick_summary": with_ctes([view("fx_reports"), ("t", r"""
SELECT doc_id, lower(strip_accents(text)) AS t, TRY_CAST(nullif(regexp_extract(lower(strip_accents(text)), '(\d+)\s+(?:defauts?|defaillances?)\s+mineur', 1), '') AS BIGINT) AS n FROM fx_reports"""),
        ("u", r"""SELECT *, regexp_matches(t, 'defaillances?\s+mineures?') AS mi, regexp_matches(t, '\bct\s*(?:ok|valide)\b|controle\s+technique\s+(?:ok|valide)') AS ok FROM t""")], """
SELECT doc_id, CASE WHEN n IS NOT NULL THEN 'CT · ' || n || ' défaut' || CASE WHEN n > 1 THEN 's mineurs' ELSE ' mineur' END WHEN mi THEN 'CT · défauts mineurs' WHEN ok THEN 'CT OK' END AS label,
  CASE WHEN n IS NOT NULL OR mi THEN 'warn' WHEN ok THEN 'ok' END AS tone FROM u"""),
    "usable_reports": with_ctes([view("fx_reports")], "SELECT doc_id FROM fx_reports WHERE length(trim(text)) >= 80"),
    "report_pages": with_ctes([view("fx_reports"), ("pg", """
SELECT doc_id, string_split(replace(text, chr(10), chr(10) || '----- PAGE -----' || chr(10)), '----- PAGE -----') AS p FROM fx_reports""")], """
SELECT doc_id, unnest(range(1, len(p) + 1)) AS page, unnest(list_transform(p, lambda x: md5(x))) AS text_md5 FROM pg"""),
}

"""Inspection reports: codes, sections, verdicts and labels from their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammertrail.functions.text import first_int, strip_accents

# --- fixed values -----------------------------------------------------------
# Headers that open the list of major and of minor defects.
MAJOR_HEADERS = [
    r"defaillances?\s+majeures?\s*:?",
    r"defaillances?\s+constatees?\s+\(?\s*ne\s+permettant\s+pas",
    r"defauts?\s+ou\s+anomalies?\s+constatees?\s+\(?\s*ne\s+permettant\s+pas",
    r"defauts?\s+ou\s+anomalies?\s+majeures?",
]
MINOR_HEADERS = [
    r"defaillances?\s+mineures?\s*:?",
    r"autres?\s+defaillances?\s+constatees?",
    r"autres?\s+defauts?\s+ou\s+anomalies?\s+constatees?",
    r"defauts?\s+ou\s+anomalies?\s+mineures?",
]
# Wording that ends any section.
STOPS = [
    r"documents?\s+presentes?",
    r"mesures?\s+realisees?",
    r"identite\s+du\s+controleur",
    r"resultat\s+(?:du\s+)?controle",
    r"prochain\s+controle",
    r"observations?\s*:",
    r"rappel\s*:",
    r"z\s*\.\s*0\s*\.\s*0\s*\.\s*0",
]
# Wording of a section without defects.
EMPTY = [
    r"aucune\s+defaillances?\s+constatees?",
    r"aucun(?:e)?\s+defauts?\s+ou\s+anomalies?",
    r"aucun(?:e)?\s+defauts?\s+constates?",
]
NOTHING, NOTHING_WITHIN = "neant", 80
# A defect code: three to five segments that start with 1 to 9, not part of a
# longer code, a date or a phone number.
CODE = (
    r"(?<![\w.,])[1-9]\d?\s*[.,]\s*\d{1,2}\s*[.,]\s*\d{1,2}(?:\s*[.,]\s*[a-z])?"
    r"(?:\s*[.,]\s*\d{1,2})?(?![\w])"
)
PLURAL = r"(?<=[a-z])\s*[(!\[]\s*s\s*[)!\]]"
SPACES = r"[\s\u00a0\u1680\u2000-\u200d\u2028\u2029\u202f\u205f\u3000\ufeff]+"
MIN_USEFUL_CHARS = 80
PAGE_BREAK = "----- PAGE -----"
# ----------------------------------------------------------------------------


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def normalize_report(col: Column) -> Column:
    """Accent-free lower case, "(s)" joined to its word, single spaces."""
    text = F.lower(strip_accents(F.coalesce(col, F.lit(""))))
    spaced = F.regexp_replace(text, SPACES, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, PLURAL, "s"), r"\s+", " "))


def defect_codes(col: Column) -> Column:
    """Distinct codes in order, commas read as dots."""
    found = F.regexp_extract_all(col, F.lit(CODE), 0)
    return F.array_distinct(
        F.transform(found, lambda x: F.translate(F.regexp_replace(x, r"\s+", ""), ",", "."))
    )


def has_header(col: Column, headers: list[str]) -> Column:
    return col.rlike(_any(headers))


def section(col: Column, headers: list[str], others: list[str]) -> Column:
    """Text from the first header to the nearest stop, NULL without header.

    The alternation finds the leftmost header, and the first pattern where
    several start at one place.
    """
    after = F.get(F.split(col, _any(headers), 2), F.lit(1))
    return F.get(F.split(after, _any([*others, *STOPS]), 2), F.lit(0))


def is_empty_section(col: Column) -> Column:
    return col.rlike(_any(EMPTY)) | F.contains(F.substring(col, 1, NOTHING_WITHIN), F.lit(NOTHING))


def _place(col: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_instr(col, F.lit(pattern)), F.lit(0))


def parse_reports(reports: DataFrame, text: str = "text") -> DataFrame:
    """Add label, tone, codes and diagnostics to a frame of report texts."""
    norm = F.col("norm")
    rows = reports.withColumn("norm", normalize_report(F.col(text)))
    rows = rows.withColumns(
        {
            "_major": section(norm, MAJOR_HEADERS, MINOR_HEADERS),
            "_minor": section(norm, MINOR_HEADERS, MAJOR_HEADERS),
            "_fav": _place(norm, r"\bfavorable\b"),
            "_unfav": _place(norm, r"\bdefavorable\b"),
            "has_defaillance": F.contains(norm, F.lit("defaillance")),
            "has_majeure": F.contains(norm, F.lit("majeure")),
            "has_mineure": F.contains(norm, F.lit("mineure")),
            "has_constatee": F.contains(norm, F.lit("constatee")),
            "has_defauts": norm.rlike(r"\bdefauts?\b"),
            "has_anomalies": norm.rlike(r"\banomalies?\b"),
            "has_volontaire": F.contains(norm, F.lit("volontaire")),
            "counter_visit": norm.rlike(r"contre[-\s]?visite"),
            "_controle": norm.rlike(r"controle\s+technique"),
            "normalized_length": F.length(norm).cast("bigint"),
        }
    )
    major, minor = F.col("_major"), F.col("_minor")
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        {
            "has_major_header": major.isNotNull(),
            "has_minor_header": minor.isNotNull(),
            "_major_empty": F.coalesce(is_empty_section(major), F.lit(False)),
            "_minor_empty": F.coalesce(is_empty_section(minor), F.lit(False)),
            "favorable": F.coalesce(F.col("_fav") < F.coalesce("_unfav", F.lit(2**31 - 1)), F.lit(False)),
            "unfavorable": F.coalesce(F.col("_unfav") < F.coalesce("_fav", F.lit(2**31 - 1)), F.lit(False)),
        }
    )
    headed = F.col("has_major_header") | F.col("has_minor_header")
    rows = rows.withColumn("_loose", F.when(headed, none).otherwise(defect_codes(norm)))
    loose = F.col("_loose")
    rows = rows.withColumns(
        {
            "major_codes": F.when(major.isNotNull() & ~F.col("_major_empty"), defect_codes(major))
            .when(~headed & F.col("unfavorable"), loose).otherwise(none),
            "minor_codes": F.when(minor.isNotNull() & ~F.col("_minor_empty"), defect_codes(minor))
            .when(~headed & F.col("favorable"), loose).otherwise(none),
            "unclassified": F.when(~F.col("favorable") & ~F.col("unfavorable"), F.size(loose))
            .otherwise(0).cast("bigint"),
        }
    )
    rows = rows.withColumns(
        {"n_major": F.size("major_codes").cast("bigint"), "n_minor": F.size("minor_codes").cast("bigint")}
    )
    return rows.withColumns(report_label()).drop(
        "norm", "_major", "_minor", "_fav", "_unfav", "_controle", "_major_empty", "_minor_empty", "_loose"
    )


def report_label() -> dict[str, Column]:
    """Label and tone: major, minor, unclassified, counter-visit, unfavourable, ok."""
    prefix = F.when(F.col("has_volontaire"), F.lit("CT volontaire")).otherwise(F.lit("CT"))
    section_words = F.col("has_defaillance") | F.col("has_defauts") | F.col("has_anomalies")
    passed = F.col("favorable") | section_words | F.col("has_volontaire") | F.col("_controle")
    seen_empty = section_words | F.col("_major_empty") | F.col("_minor_empty")

    def counted(n: Column, word: str) -> Column:
        plural = F.when(n > 1, F.lit("s")).otherwise(F.lit(""))
        kind = F.concat(F.lit(" " + word), plural) if word else F.lit("")
        return F.concat(prefix, F.lit(" · "), n.cast("string"), F.lit(" défaut"), plural, kind)

    def said(text: str) -> Column:
        return F.concat(prefix, F.lit(text))

    cases = [
        (F.col("n_major") > 0, counted(F.col("n_major"), "majeur"), "bad"),
        (F.col("n_minor") > 0, counted(F.col("n_minor"), "mineur"), "warn"),
        (F.col("unclassified") > 0, counted(F.col("unclassified"), ""), "warn"),
        (F.col("counter_visit"), said(" · contre-visite"), "bad"),
        (F.col("unfavorable"), said(" · défavorable"), "bad"),
        (passed & seen_empty, said(" OK (vide)"), "ok"),
        (passed, said(" OK"), "ok"),
    ]
    blank = F.col("normalized_length") == 0
    label, tone = F.when(blank, F.lit(None).cast("string")), F.when(blank, F.lit(None).cast("string"))
    for cond, text, kind in cases:
        label, tone = label.when(cond, text), tone.when(cond, F.lit(kind))
    return {"label": label, "tone": tone}


def report_snippet(text: Column) -> dict[str, Column]:
    """Where the defect vocabulary starts, and the text around it."""
    norm = normalize_report(text)
    at = F.instr(norm, "defaillance")
    start = F.greatest(F.lit(1), at - 40)
    return {
        "first_index": (at - 1).cast("bigint"),
        "snippet": F.when(at == 0, F.lit("")).otherwise(F.substring(norm, start, at + 200 - start)),
    }


def quick_summary(*texts: Column) -> dict[str, Column]:
    """Label and tone from free text that mentions an inspection."""
    text = F.lower(strip_accents(F.concat_ws("\n", *texts)))
    n = first_int(text, r"(\d+)\s+(?:defauts?|defaillances?)\s+mineur")
    plural = F.when(n > 1, F.lit("s")).otherwise(F.lit(""))
    counted = F.concat(F.lit("CT · "), n.cast("string"), F.lit(" défaut"), plural, F.lit(" mineur"), plural)
    minor = text.rlike(r"defaillances?\s+mineures?")
    passed = text.rlike(r"\bct\s*(?:ok|valide)\b|controle\s+technique\s+(?:ok|valide)")
    return {
        "label": F.when(n.isNotNull(), counted).when(minor, F.lit("CT · défauts mineurs")).when(passed, F.lit("CT OK")),
        "tone": F.when(n.isNotNull() | minor, F.lit("warn")).when(passed, F.lit("ok")),
    }


def usable_reports(reports: DataFrame, text: str = "text", least: int = MIN_USEFUL_CHARS) -> DataFrame:
    """Reports with enough recognised text to read."""
    return reports.filter(F.length(F.trim(text)) >= least)


def report_pages(reports: DataFrame, text: str = "text") -> DataFrame:
    """One row per page of a report, numbered from 1; an empty page keeps its number, a NULL text has no page."""
    pages = F.split(text, r"\Q" + PAGE_BREAK + r"\E", -1)
    rest = [c for c in reports.columns if c != text]
    return reports.select(*rest, F.posexplode(pages).alias("_at", text)).select(*rest, (F.col("_at") + 1).alias("page"), text)


def code_frequency(parsed: DataFrame) -> DataFrame:
    """How often each code occurs, by severity."""
    tagged = F.concat(
        F.transform("major_codes", lambda c: F.struct(F.lit("major").alias("severity"), c.alias("code"))),
        F.transform("minor_codes", lambda c: F.struct(F.lit("minor").alias("severity"), c.alias("code"))),
    )
    return parsed.select(F.explode(tagged).alias("x")).select("x.*").groupBy("severity", "code").agg(
        F.count("*").alias("n")
    )


def report_rollup(parsed: DataFrame) -> DataFrame:
    """Reports and defects per tone and label."""
    return parsed.groupBy("tone", "label").agg(
        F.count("*").alias("n_reports"), F.sum("n_major").alias("n_major"), F.sum("n_minor").alias("n_minor")
    )

"""Report queries over the document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hammertrail.operators import reports as R
from hammertrail.sources.views import load_view


def _texts(spark, d):
    return load_view(spark, d, "fx_reports")


def _parsed(spark, d):
    return R.parse_reports(_texts(spark, d))


def report_label(spark, d):
    return _parsed(spark, d).select(
        "doc_id", "label", "tone", F.array_join("major_codes", ",").alias("major_codes"),
        F.array_join("minor_codes", ",").alias("minor_codes"), "unclassified",
    )


def report_diagnostics(spark, d):
    cols = ["has_defaillance", "has_defauts", "has_anomalies", "has_volontaire", "has_major_header",
            "has_minor_header", "favorable", "unfavorable", "counter_visit", "normalized_length"]
    return _parsed(spark, d).select("doc_id", *cols)


def report_snippet(spark, d):
    return _texts(spark, d).select("doc_id", *[v.alias(k) for k, v in R.report_snippet(F.col("text")).items()])


def report_rollup(spark, d):
    return R.report_rollup(_parsed(spark, d))


def code_frequency(spark, d):
    return R.code_frequency(_parsed(spark, d))


def quick_summary(spark, d):
    return _texts(spark, d).select("doc_id", *[v.alias(k) for k, v in R.quick_summary(F.col("text")).items()])


def usable_reports(spark, d):
    return R.usable_reports(_texts(spark, d)).select("doc_id")


def report_pages(spark, d):
    """Pages of reports whose lines stand on pages of their own."""
    paged = _texts(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit(f"\n{R.PAGE_BREAK}\n")))
    return R.report_pages(paged).select("doc_id", F.col("page").cast("bigint").alias("page"), F.md5("text").alias("text_md5"))


QUERIES = {
    f.__name__: f
    for f in [report_label, report_diagnostics, report_snippet, report_rollup, code_frequency, quick_summary, usable_reports, report_pages]
}

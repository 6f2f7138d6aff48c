"""Readers with validation: lot lists, detail records, list items, reports, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hammertrail import schemas as S

TYPES = {"string": "string", "number": "double", "boolean": "boolean", "strings": "array<string>", "coerced": "double"}


def read_lots_csv(spark: SparkSession, path: str) -> DataFrame:
    """Auction list: quoted CSV with header, empty fields are NULL."""
    return spark.read.schema(S.LOTS_CSV).option("header", True).option("quote", '"').csv(path)


def _raw(field: str, record: Column | str = "_v") -> Column:
    """JSON token of a field as text with its quotes, NULL when absent."""
    return F.variant_get(record, f"$.{field}", "variant")


def _kind(field: str, record: Column | str = "_v") -> Column:
    """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, ARRAY<..>, OBJECT<..>, VOID or NULL."""
    return F.schema_of_variant(_raw(field, record))


def _fits(field: str, kind: str, record: Column | str = "_v") -> Column:
    token = _kind(field, record)
    if kind == "string":
        return token == "STRING"
    if kind == "boolean":
        return token == "BOOLEAN"
    if kind == "strings":
        return token.isin("ARRAY<STRING>", "ARRAY<VOID>")
    if kind == "coerced":
        number = F.try_variant_get(record, f"$.{field}", "string").try_cast("double")
        return number.isNotNull() | token.isin("VOID", "BOOLEAN")
    return token.rlike("^(BIGINT|DECIMAL|DOUBLE)")


def _value(field: str, kind: str, default) -> Column:
    value = F.try_variant_get("_v", f"$.{field}", TYPES[kind])
    if kind == "strings":
        return F.coalesce(value, F.array().cast("array<string>")) if field == "photoUrls" else value
    return value if default is None else F.coalesce(value, F.lit(default).cast(TYPES[kind]))


def validate_details(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split JSON lines (column ``value``) into good records and rejects.

    A record is rejected as a whole when it is no JSON object, lacks a
    required field, or holds a field of the wrong JSON kind: numbers and texts
    are not coerced into each other.
    """

    def issues(record: Column) -> Column:
        problems = []
        for field, kind in S.DETAIL_FIELDS.items():
            bad = F.coalesce(~_fits(field, kind, record), F.lit(False))
            if field in S.DETAIL_REQUIRED:
                bad = _kind(field, record).isNull() | bad
            problems.append(F.when(bad, F.lit(field)))
        return F.when(record.isNull(), F.array(F.lit("json"))).otherwise(F.array_compact(F.array(*problems)))

    # The filters below are evaluated on the text; the array of one keeps it from being parsed once for each field.
    parsed = F.try_parse_json("value")
    rows = lines.withColumn("issues", F.get(F.transform(F.array(parsed), issues), F.lit(0)))
    good = rows.filter(F.size("issues") == 0).withColumn("_v", parsed).select(
        *[_value(f, k, S.DETAIL_DEFAULTS.get(f)).alias(f) for f, k in S.DETAIL_FIELDS.items()]
    )
    return good, rows.filter(F.size("issues") > 0).select("value", "issues")


def read_snapshots_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return validate_details(spark.read.text(path))


def validate_items(lines: DataFrame) -> DataFrame:
    """Explode {"vehicles": [...]} lines into items with a ``valid`` flag.

    Bad items are flagged one by one; year and mileage accept numeric text.
    """
    payload = F.try_variant_get(F.try_parse_json("value"), "$.vehicles", "array<variant>")
    items = lines.select(F.explode(payload).alias("_v"))
    valid = F.coalesce(_kind("hashId") == "STRING", F.lit(False)) & (
        F.coalesce(F.try_variant_get("_v", "$.hashId", "string"), F.lit("")) != ""
    )
    for field, kind in S.LIST_FIELDS.items():
        token = _kind(field)
        ok = token.isNull() | F.coalesce(_fits(field, kind), F.lit(False))
        if field in S.LIST_NULLABLE:
            ok = ok | (token == "VOID")
        valid = valid & ok
    return items.withColumn("valid", valid).select(
        "valid", *[_value(f, k, S.LIST_DEFAULTS.get(f)).alias(f) for f, k in S.LIST_FIELDS.items()]
    )


def read_list_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid items, and one row with the number of skipped ones."""
    items = validate_items(spark.read.text(path))
    skipped = items.agg(F.count_if(~F.col("valid")).alias("skipped"))
    return items.filter("valid").drop("valid"), skipped


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages: Parquet with page_id, url, html."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report file; the id is the file name."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("report_id"), F.col("value").alias("text")
    )


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Entity, snapshot and watchlist tables of a store."""
    return {t: spark.read.parquet(f"{path}/{t}") for t in ["vehicles", "snapshots", "watchlist"]}

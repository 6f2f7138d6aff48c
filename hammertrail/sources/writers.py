"""Writers: tables by day, upserts, repairs, JSON documents.

A table is a folder of Parquet partitioned by the day of ``time``. Changes rewrite the days they touch by dynamic
partition overwrite, which replaces a day when its job is committed; all other days keep their files. Writers of one
table must not run at the same time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIME = "scraped_at"
#: Partition column, and the mark of a row whose key has moved to another day.
DAY, GONE = "day", "gone"


def _stored(spark: SparkSession, table: str) -> DataFrame | None:
    """All stored rows with ``DAY`` and ``GONE``; NULL for a table that is not there."""
    try:
        return spark.read.parquet(table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_table(spark: SparkSession, table: str) -> DataFrame | None:
    rows = _stored(spark, table)
    return rows if rows is None else rows.filter(~F.col(GONE)).drop(DAY, GONE)


def _dated(rows: DataFrame, time: str) -> DataFrame:
    return rows.withColumns({GONE: F.lit(False), DAY: F.to_date(time)})


def _within(days: DataFrame) -> Column:
    """Condition that a row lies in ``days``; a literal list, so that the scan reads those folders only.

    The list holds calendar days of one batch, not rows.
    """
    found = [r[0] for r in days.distinct().collect()]
    known = F.col(DAY).isin([d for d in found if d is not None])
    return known | F.col(DAY).isNull() if None in found else known


def _replace_days(rows: DataFrame, table: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(table)


def upsert_snapshots(spark: SparkSession, table: str, rows: DataFrame, key: str = "id", time: str = TIME) -> None:
    """Replace rows of equal key and append the others; ``key`` is unique and not NULL within ``rows``.

    A stored row whose key moves to another day is marked and not removed, since a day left without rows would not
    be overwritten.
    """
    new = _dated(rows, time)
    stored = _stored(spark, table)
    if stored is None:
        return _replace_days(new, table)
    to = new.select(key, F.col(DAY).alias("_to"), F.lit(True).alias("_hit"))
    touched = stored.join(to.select(key), key, "left_semi").select(DAY).unionByName(new.select(DAY))
    old = stored.filter(_within(touched)).join(to, key, "left")
    same_day = F.col(DAY).eqNullSafe(F.col("_to"))
    kept = old.filter(F.col("_hit").isNull() | ~same_day).withColumn(GONE, F.col(GONE) | F.col("_hit").isNotNull())
    _replace_days(kept.select(*stored.columns).unionByName(new.select(*stored.columns)), table)


def append_list_snapshots(table: str, items: DataFrame, time: str = TIME) -> None:
    """Store a list batch by one job, whose files appear when it is committed. Nothing stored is read."""
    _dated(items, time).write.mode("append").partitionBy(DAY).parquet(table)


def apply_price_repair(spark: SparkSession, table: str, changes: DataFrame, dry_run: bool = True) -> DataFrame:
    """Blank the starting price of the given snapshot ids.

    Returns the change set. Unless ``dry_run``, the rows to change are written to a folder beside the table first
    and the days that hold them are replaced.
    """
    stored = _stored(spark, table)
    if dry_run or stored is None:
        return changes
    hit = changes.select("id").distinct().withColumn("_hit", F.lit(True))
    found = stored.join(hit, "id", "left_semi")
    found.write.parquet(f"{table.rstrip('/')}-before-{uuid.uuid4().hex}")
    price = F.when(F.col("_hit").isNull(), F.col("starting_price"))
    days = stored.filter(_within(found.select(DAY)))
    fixed = days.join(hit, "id", "left").withColumn("starting_price", price)
    _replace_days(fixed.select(*stored.columns), table)
    return changes


def write_documents(docs: DataFrame, path: str) -> None:
    """History documents as JSON lines."""
    docs.write.json(path)

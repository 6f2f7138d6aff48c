"""Readers, settings and byte-level text helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hammertrail.session import apply_settings, cut_lineage

#: Python workers see texts in small Arrow batches, so that a batch of very long texts stays small.
BATCH_ROWS = 256
BATCH_BYTES = "8m"


def prepare(spark: SparkSession) -> SparkSession:
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, which is Java's ``\\S+``; null counts as no word."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """32 bits of MD5 over the parts as a long; the same in every engine that has MD5."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def crc_of_id(column: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over a 64-bit word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered for at most ``limit`` words at a time."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.limit:
            known.clear()
        for word in set(words).difference(known):
            known[word] = digest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words count as one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed((out * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[k : n - width + 1 + k])
    return out


def with_positions(df: DataFrame, groups: list[str], order: list[str], extra: DataFrame | None = None) -> DataFrame:
    """``df`` with ``position`` (long, from 0), the place of each row within its group in the given order.

    One range shuffle sorts the table; only one row per (partition, group) is ordered per group, so a group that
    holds most rows spreads over all tasks. Nulls come first. Rows with equal keys are told apart by their place in
    ``df``, which must be a written table when such rows differ in other columns. ``extra`` holds columns of whole
    groups, keyed by ``groups``; they reach the rows through the small table and never by a join on a hot key.
    """
    keys = [*groups, *order, "_tie"]
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
        .withColumn("_row", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id() is the partition in the upper bits and the place in it in the lower 33.
    ranged = cut_lineage(ranged.withColumn("_part", F.shiftright("_row", 33)))
    cells = ranged.groupBy("_part", *groups).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if extra is not None:
        cells = null_safe_join(cells, extra, groups, "inner")
    added = [] if extra is None else [c for c in extra.columns if c not in groups]
    placed = null_safe_join(ranged, cells, ["_part", *groups], "inner")
    return placed.select(*df.columns, *added, (F.col("_row") - F.col("_first") + F.col("_before")).alias("position"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, nulls equal to each other; the keys of ``right`` are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    matches = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    condition = matches[0]
    for match in matches[1:]:
        condition = condition & match
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])

"""Order-dependent building blocks that stay balanced when one key is hot.

A plain window over (key ORDER BY time) sends every row of a key to one task.
The helpers here split a key by a calendar chunk first, and a chunk of more
than ``HOT_ROWS`` rows by ranges of its order, so a task holds one part of one
chunk of one key; only one small row per part is ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammertrail.session import cut_lineage

#: Rows of one key in one calendar chunk that one task may order.
HOT_ROWS = 1 << 16


def _chunked(df: DataFrame, keys: list[str], chunk: Column, order: list[Column]) -> DataFrame:
    """``df`` with ``_chunk``: the calendar chunk, and the range of the order that a row of a hot chunk falls in.

    Hot chunks are found by counting; there is at most one per ``HOT_ROWS`` rows. Only their rows are shuffled once
    more, by range, and written, so that their parts stay what they are.
    """
    rows = df.withColumn("_chunk", F.struct(chunk.alias("at"), F.lit(0).alias("part")))
    hot = rows.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.col("_chunk.at").alias("_hot_at")).count()
    hot = hot.filter(F.col("count") > HOT_ROWS).drop("count")
    if hot.isEmpty():
        return rows
    hot = cut_lineage(hot)
    same = F.col("_chunk.at") == F.col("_hot_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    part = F.struct(F.col("_chunk.at").alias("at"), (F.spark_partition_id() + 1).alias("part"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    warm = rows.join(hot, same, "left_semi").repartitionByRange(parts, *keys, *order).withColumn("_chunk", part)
    return rows.join(hot, same, "left_anti").unionByName(cut_lineage(warm))


def latest_by(df: DataFrame, keys: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """The last row per key; map-side partial aggregation, no window."""
    pick = F.max_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    """First ``n`` rows per key with their rank.

    ``row_number() <= n`` lets every map task keep at most ``n`` rows per key
    before the shuffle.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def running_total(
    df: DataFrame, keys: list[str], chunk: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over the rows of a key up to each row, in ``order``.

    ``chunk`` must be non-null and must not decrease along ``order``. The
    input is read twice, so hand in a written or cheap frame.
    """
    rows = _chunked(df, keys, chunk, order).withColumn("_value", value)
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_sum", F.sum("_value").over(inner))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_sum") + F.col("_off"))
        .drop("_chunk", "_value", "_sum", "_off")
    )


def positions(
    df: DataFrame, keys: list[str], chunk: Column, order: list[Column], name: str
) -> DataFrame:
    """1-based position of each row within its key, in ``order``."""
    return running_total(df, keys, chunk, order, F.lit(1).cast("bigint"), name)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its place in a total order as ``name``, from 0.

    One range shuffle sorts; a place is that within its partition plus the
    rows of the partitions before, which is one row each.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    # monotonically_increasing_id() is the partition in the upper bits and the place in it in the lower 33.
    ranged = cut_lineage(ranged.withColumn("_part", F.shiftright("_row", 33)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    parts = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(parts, "_part").select(*df.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias(name))


def with_previous(
    df: DataFrame, keys: list[str], chunk: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """``value`` (a struct) of the row before, NULL for the first row of a key.

    ``chunk`` must be non-null and must not decrease along ``order``. Rows
    inside a chunk look back within it; only the first row of a chunk needs
    the last row of the chunk before, so just those boundary rows are ordered
    per key. Both branches read the same exchange.
    """
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    rows = (
        _chunked(df, keys, chunk, order)
        .withColumn("_value", value)
        .withColumn("_at", F.row_number().over(inner))
        .withColumn("_lag", F.lag("_value").over(inner))
        .withColumn("_last", F.lead(F.lit(1)).over(inner).isNull())
    )
    across = Window.partitionBy(*keys).orderBy("_chunk", "_at")
    firsts = (
        rows.filter((F.col("_at") == 1) | F.col("_last"))
        .withColumn("_lag", F.lag("_value").over(across))
        .filter(F.col("_at") == 1)
    )
    return (
        rows.filter(F.col("_at") > 1).unionByName(firsts)
        .withColumnRenamed("_lag", name)
        .drop("_chunk", "_value", "_at", "_last")
    )


def with_next(
    df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: Column, name: str
) -> DataFrame:
    """First non-null ``value`` strictly after each row of a key.

    ``order`` names ascending columns; ``chunk`` must be non-null and must not
    decrease along them.
    """
    rows = _chunked(df, keys, chunk, [F.col(c) for c in order]).withColumn("_value", value)
    heads = rows.groupBy(*keys, "_chunk").agg(
        F.min_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_head")
    )
    back = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc())
    earlier = (Window.unboundedPreceding, -1)
    carried = heads.select(
        *keys, "_chunk", F.last("_head", ignorenulls=True).over(back.rowsBetween(*earlier)).alias("_carry")
    )
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(c).desc() for c in order])
    return (
        rows.withColumn("_near", F.last("_value", ignorenulls=True).over(inner.rowsBetween(*earlier)))
        .join(carried, [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_near", "_carry"))
        .drop("_chunk", "_value", "_near", "_carry")
    )

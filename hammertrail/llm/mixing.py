"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the words of all documents; a target stops
at ``MAX_COPIES`` times its source and the rest is shared anew by weight, which is min(cap, level * weight) for one
level, found by prefix sums over the sources sorted by cap / weight: with the first k sources at their caps the others reach
``level`` k, and the right k is the one of the largest level that fits its own source.

A source with target / size = r expects r copies of each document. Its documents are put in order of size; the one
at place i is emitted once for every integer in (r * (i - 1) + u, r * i + u], with one offset u per source and seed.
Neighbours in that order are alike in size, so the words taken come near the target. Places are prefix sums in two
steps, over (source, size class, hash) cells and inside a cell, so no source is ordered in one task.

Defined cases: a null text has size 0; a source of size 0 has target 0 and is left out; rows with the same id are
separate documents; further columns pass through, except that the columns added here are replaced; no rows give no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hammertrail.llm.common import unit_hash, word_count
from hammertrail.session import cut_lineage

MAX_COPIES = 3
#: Size classes per doubling, and hash cells per class.
CLASSES, CELLS = 8, 8
SEED = 7
#: Offsets are odd multiples of 1 / 8192, exact in sums up to 5e11 places.
OFFSETS = 4096


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from the columns ``source`` and ``size``; one row per source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = (
        sources.withColumn("weight", ((F.row_number().over(in_order) - 1) % 3 + 1).cast("double"))
        .withColumn("cap", (MAX_COPIES * F.col("source_size")).cast("double"))
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.withColumn(
        "level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    )
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return levels.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def _class(size):
    return F.floor(CLASSES * F.log2(size + F.lit(1.0))).cast("int")


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per row of ``docs``."""
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    per_source = cut_lineage(targets(sized))
    placed = sized.withColumn("class", _class(F.col("size"))).withColumn("cell", unit_hash(F.lit(SEED), F.col("doc_id")) % CELLS)
    keys = ["source", "class", "cell"]
    cells = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*(F.col(k).alias(f"_{k}") for k in keys), "_before")
    inside = Window.partitionBy(*keys).orderBy("size", unit_hash(F.lit(SEED + 1), F.col("doc_id")), "doc_id")
    ranked = placed.withColumn("_place", F.row_number().over(inside))
    same_cell = F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")) & (F.col("cell") == F.col("_cell"))
    ranked = ranked.join(cells, same_cell).withColumn("_place", F.col("_place") + F.col("_before")).select("doc_id", "source", "size", "_place")
    per_source = per_source.withColumnRenamed("source", "_source")
    joined = ranked.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = (unit_hash(F.lit(SEED + 2), F.col("source")) % OFFSETS + 0.5) / OFFSETS
    copies = F.floor(rate * F.col("_place") + offset) - F.floor(rate * (F.col("_place") - 1) + offset)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as often as the mixture takes it.

    Copies are assigned to rows by (doc_id, source, size); rows that agree in all three share theirs in any order.
    """
    keys = ["doc_id", "source", "size"]
    # Rows with one id are told apart by number; an id is rarely repeated, so these windows are small.
    drawn = mixture(docs).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    drawn = drawn.filter("copies > 0").select(*(F.col(k).alias(f"_drawn_{k}") for k in keys), "_nth", "copies")
    rows = docs.withColumn("_size", word_count(F.col("text")))
    rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy(F.lit(1))))
    same = (
        rows["doc_id"].eqNullSafe(F.col("_drawn_doc_id")) & rows["source"].eqNullSafe(F.col("_drawn_source"))
        & (F.col("_size") == F.col("_drawn_size")) & (F.col("_row") == F.col("_nth"))
    )
    repeated = rows.join(drawn.withColumnRenamed("copies", "_copies"), same)
    return repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(docs.columns)

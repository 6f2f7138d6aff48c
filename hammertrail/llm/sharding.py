"""Shards of near equal bytes, tokens and rows by vector bin packing of groups of equal texts.

A group of equal texts has three sizes: bytes, tokens (words) and rows. Groups of more than one in ``BIG`` of the
table in any size are placed one by one; there are at most 3 * ``BIG`` of them. All smaller groups are dealt by the
hash of their text to ``BUNDLES`` bundles, which are placed like groups. A group of more than ``WHOLE`` of a shard's
capacity is cut into as many equal pieces of consecutive ids as there are shards, so that all can stay equal.
Placing takes the largest first and gives each to the shard whose residual capacity, as a vector of the three shares,
has the highest dot product with it. So the driver sees a bounded number of size vectors and returns a shard for each;
rows, texts and groups stay on the executors. Equal texts share a shard unless they are more than ``WHOLE`` of it.

Texts are read once; everything after works on (id, digest, sizes). Slots number the rows of a shard by id with a
range sort, as no shard may gather in one task. Broadcast are at most 3 * ``BIG`` digests and ``BUNDLES`` numbers.

Defined cases: a null text has the size of an empty one, and its checksum, but is a group of its own; rows without
an id come first in their shard; ties of placing go to the smallest shard, of slots to equal rows in any order;
repeated rows are rows of their own; further columns pass through ``shards`` unless it sets them; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammertrail.llm.common import prepare, with_positions, word_count
from hammertrail.session import cut_lineage

#: A group above one in so many of all bytes, tokens or rows is placed by itself.
BIG = 4096
#: Bundles of the other groups.
BUNDLES = 8192
#: A group is cut into pieces, one for each shard, beyond this part of a shard's capacity.
WHOLE = 0.5

SIZES = ["bytes", "tokens", "rows"]


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of ``vectors`` (shares of the whole): largest first, by the dot product with what is free."""
    free = np.full((shards, vectors.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(vectors), np.int64)
    for item in np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1, initial=0))):
        chosen[item] = np.argmax(free @ vectors[item])
        free[chosen[item]] -= vectors[item]
    return chosen


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, size, tokens, text_crc32) of every row; the only pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(F.col("text").cast("binary")))).alias("digest"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        word_count(F.col("text")).alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def shards(docs: DataFrame, count: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, tokens, shard, slot."""
    spark = prepare(docs.sparkSession)
    rows = cut_lineage(measured(docs))
    groups = cut_lineage(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    totals = np.array(groups.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in SIZES]).first(), float)
    totals = np.maximum(totals, 1)
    share = F.greatest(*[F.col(c) / float(t) for c, t in zip(SIZES, totals, strict=True)])
    bundle = F.pmod(F.xxhash64("digest"), F.lit(BUNDLES))
    big = groups.filter(share > 1 / BIG).withColumn(
        "pieces", F.when(share * count > WHOLE, F.least("rows", F.lit(count))).otherwise(1)
    )
    small = groups.filter(share <= 1 / BIG).groupBy(bundle.alias("bundle")).agg(*[F.sum(c).alias(c) for c in SIZES])

    big_rows = big.orderBy("digest").collect()  # at most 3 * BIG: the shares of one size sum to one
    small_rows = small.orderBy("bundle").collect()  # at most BUNDLES
    items = [
        (bytes(r.digest), p, np.array([r.bytes, r.tokens, r.rows]) * (-(-(p + 1) * r.rows // r.pieces) + -p * r.rows // r.pieces) / r.rows)
        for r in big_rows for p in range(r.pieces)
    ]
    vectors = np.array([v for *_, v in items] + [[r.bytes, r.tokens, r.rows] for r in small_rows], float).reshape(-1, 3) / totals
    chosen = place(vectors, count).tolist()

    singles = spark.createDataFrame(
        [(d, p, s) for (d, p, _), s in zip(items, chosen, strict=False)], "digest binary, piece int, shard int"
    )
    bundles = spark.createDataFrame(
        [(r.bundle, s) for r, s in zip(small_rows, chosen[len(items):], strict=True)], "bundle long, shard int"
    )
    cut = big.filter("pieces > 1").select("digest", "pieces", F.col("rows").alias("n"))
    known = F.broadcast(big.select("digest", (F.col("pieces") > 1).alias("cut")))
    marked = rows.join(known, "digest", "left")
    # Rows of groups that are cut are numbered within their group and dealt in equal runs.
    split = with_positions(
        cut_lineage(marked.filter("cut").drop("cut")), ["digest"], ["doc_id"], cut
    ).withColumn("piece", F.expr("CAST(position * pieces div n AS int)"))
    columns = ["doc_id", "size", "text_crc32", "tokens", "shard"]
    whole = marked.filter("NOT cut").withColumn("piece", F.lit(0)).select(*rows.columns, "piece")
    alone = split.select(whole.columns).unionByName(whole).join(F.broadcast(singles), ["digest", "piece"]).select(columns)
    together = marked.filter("cut IS NULL").withColumn("bundle", bundle).join(F.broadcast(bundles), "bundle").select(columns)
    placed = cut_lineage(alone.unionByName(together))
    return with_positions(placed, ["shard"], ["doc_id"]).withColumnRenamed("position", "slot")

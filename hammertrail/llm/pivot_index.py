"""Embedding near-dedup with a pivot-permutation index.

Reference points (pivots) are taken from a bounded sample of the vectors. Every vector is described by its ``NEAREST``
pivots in order of nearness. Vectors closer than the threshold see the pivots in nearly the same order, so candidates
are pairs with the same label that share at least ``SHARED`` of these pivots. A vector enters the inverted lists of its
``NEAREST - SHARED + 1`` lowest numbered pivots, in which every such pair meets; a pair is looked at in the list of the
lowest pivot that it shares, and candidates are verified by cosine in double precision. Measured on random vectors of
64 components at a cosine of 0.93 the index finds 99.9 % of the links, and more above.

A list of more than ``BLOCK`` vectors is cut into blocks, and every pair of blocks is a group of its own, so no list is
gathered in one task. A group gives, per vector, a number of links and one spanning edge, never its pairs.

Every length of vectors has pivots of its own. A length that the sample misses has one list, compared in full by blocks.

Defined cases: equal vectors of a label are compared once and count for each id that holds them; vectors that are null,
empty, zero or hold null or non-finite components, and rows without label or id, link with nothing; rows with equal id,
label and vector are one vector, and different vectors under one id stand for themselves; vectors of different lengths
do not link; of equally near pivots the first counts as nearer; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammertrail.operators.identity import connected_components
from hammertrail.session import cut_lineage

SAMPLE, NEAREST, SHARED, BLOCK = 2048, 12, 4, 512
#: The number of pivots grows with the root of the number of vectors, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 256, 2048
#: Pivots are pairwise less similar than this.
SPREAD = 0.9

LISTED = "label string, pivot int, block int, rep long, n long, near binary, vector binary"


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def choose_pivots(sample: list[list[float]], wanted: int) -> dict[int, np.ndarray]:
    """For each length up to ``wanted`` sampled vectors that are not close to each other."""
    pivots = {}
    for length in {len(x) for x in sample}:
        rows = units(np.array([x for x in sample if len(x) == length]))
        chosen: list[int] = []
        for k in range(len(rows)):
            if len(chosen) == wanted:
                break
            if not chosen or (rows[chosen] @ rows[k]).max() < SPREAD:
                chosen.append(k)
        pivots[length] = rows[chosen]
    return pivots


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray | None) -> tuple[np.ndarray, int]:
    """The nearest pivots of each row in order, and how many of them linked rows share; without pivots one for all."""
    if pivots is None:
        return np.zeros((len(unit), 1), np.int64), 1
    near = min(NEAREST, len(pivots))
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :near], min(SHARED, near)


def _local_roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest id reachable from each row over the edges (i, j)."""
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (before == root).all():
            return root


def links_and_components(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = np.float32 if single else np.float64
    distinct = rows.filter(valid).distinct().groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # Classes are told apart by number, since an id may stand before several vectors.
    classes = cut_lineage(distinct.withColumn("rep", F.monotonically_increasing_id()))
    wanted = max(LEAST_PIVOTS, min(MOST_PIVOTS, isqrt(classes.count())))
    sample = classes.orderBy(F.xxhash64("embedding"), "least", "label").limit(SAMPLE).select("embedding").collect()
    pivots = choose_pivots([r.embedding for r in sample], wanted)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["embedding"].value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                flat = part["embedding"].flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(part.num_rows, -1)
                near, shared = nearest_pivots(units(flat), pivots.get(int(length)))
                lists = np.sort(near, axis=1)[:, : near.shape[1] - shared + 1]
                take = pa.array(np.repeat(np.arange(part.num_rows), lists.shape[1]))
                wide = pa.RecordBatch.from_arrays(
                    [part["label"], part["rep"], part["n"], pa.array([x.astype(np.uint16).tobytes() for x in near]), pa.array([x.tobytes() for x in flat])],
                    ["label", "rep", "n", "near", "vector"],
                ).take(take)
                wide = wide.append_column("pivot", pa.array(lists.ravel().astype(np.int32)))
                yield wide.append_column("length", pa.array(np.full(wide.num_rows, length, np.int32)))

    listed = classes.mapInArrow(describe, "label string, rep long, n long, near binary, vector binary, pivot int, length int")
    lists = ["label", "length", "pivot"]
    sizes = listed.groupBy(*lists).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    listed = listed.join(sizes, lists).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = listed.withColumn("_other", other).select(
        *lists, F.least("block", "_other").alias("first"), F.greatest("block", "_other").alias("second"),
        "block", "rep", "n", "near", "vector",
    )

    def compare(group: pa.Table) -> pa.Table:
        pivot, first, second = (group[c][0].as_py() for c in ("pivot", "first", "second"))
        reps, n, block = (group[c].to_numpy() for c in ("rep", "n", "block"))
        near = np.frombuffer(b"".join(group["near"].to_pylist()), np.uint16).reshape(len(reps), -1)
        shared = min(SHARED, near.shape[1])
        seen = np.zeros((len(reps), int(near.max()) + 1), np.float32)
        seen[np.arange(len(reps))[:, None], near] = 1
        unit = units(np.frombuffer(b"".join(group["vector"].to_pylist()), kind).reshape(len(reps), -1))
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        together = seen[left] @ seen[right].T
        earlier = seen[left][:, :pivot] @ seen[right][:, :pivot].T
        a, b = np.nonzero((together >= shared) & (earlier == 0))
        i, j = left[a], right[b]
        if first == second:
            i, j = i[i < j], j[i < j]
        close = np.concatenate([np.einsum("ij,ij->i", unit[i[k : k + 4096]], unit[j[k : k + 4096]]) for k in range(0, len(i), 4096)] or [np.zeros(0)])
        i, j = i[close >= threshold], j[close >= threshold]
        links = np.bincount(i, n[j], len(reps)) + np.bincount(j, n[i], len(reps))
        root = _local_roots(reps, i, j)
        out = pa.table({"rep": pa.array(reps), "links": pa.array(links.astype(np.int64)), "root": pa.array(root)})
        return out.filter(pa.array(links > 0))

    found = cut_lineage(paired.groupBy(*lists, "first", "second").applyInArrow(compare, "rep long, links long, root long"))
    components = connected_components(found.filter("root != rep").select(F.col("root").alias("src"), F.col("rep").alias("dst")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = classes.join(components.withColumnRenamed("id", "rep"), "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))
    joined = cut_lineage(joined.join(counted, "rep", "left"))
    names = joined.groupBy("cluster").agg(F.min("least").alias("component_id"))
    of_class = (
        joined.join(names, "cluster")
        .select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
                (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    )
    joined = rows.withColumn("_valid", F.coalesce(valid, F.lit(False))).join(
        of_class, F.col("_valid") & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left"
    )
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )

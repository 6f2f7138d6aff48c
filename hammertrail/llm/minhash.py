"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds the distinct runs of ``size`` words; two documents are linked when 100 * intersection >=
``percent`` * union, and each component of links keeps its smallest id.

* Documents with equal sets form one class, found by a digest of the whole set; one row per class goes on.
* Bands of a MinHash signature name buckets. A bucket is never expanded into all its pairs at first: its smallest
  member is paired with every other one, which is linear, and only buckets that then still hold several components
  are compared across those components, in blocks that give confirmed links and not their pairs.
* A candidate pair compares its signatures in batches of ``BATCH`` values. After each batch the posterior of the
  similarity, from a uniform prior, is an exact binomial tail; the pair is dropped once the chance that it reaches
  the threshold is below ``MISS``.
* Survivors are verified on their full sets, first one per document, then those that still cross components.

With ``BANDS`` bands of ``ROWS`` values a pair at the threshold of 0.8 misses all buckets with a chance of 2e-6.

Defined cases: a text without words, or null, has an empty set, is linked with nothing and is kept; fewer words than
``size`` count as one run; rows are compared by their sets, whatever their ids, and rows with one id are linked
through it, but for those with empty sets; rows without an id take the smallest id of their component, null where it
has none; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammertrail.llm.common import WordHashes, mixed, shingles
from hammertrail.operators.identity import connected_components
from hammertrail.session import cut_lineage

BANDS, ROWS = 56, 7
#: Signature values kept for verification, 16 bits each, compared ``BATCH`` at a time.
KEPT, BATCH = 256, 32
#: A pair is dropped when its posterior chance to reach the threshold is smaller.
MISS = 1e-6
#: Rows of a block of a large bucket, and rows that small buckets gather in one group.
BLOCK, GROUP_ROWS = 512, 4096
#: Rows of buckets around one component that share a group, where a document of several such buckets is one row.
SHARED_ROWS = 32768
#: Columns of a set hashed at once.
CHUNK = 2048


@cache
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240817)
    a = random.integers(1, 2**32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
    return a, random.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32)


def signature(members: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set of 64-bit members."""
    a, b = _coefficients()
    low = (members >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(low), CHUNK):
        values = low[None, at : at + CHUNK] * a
        values += b
        np.minimum(best, values.min(axis=1), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in best.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = mixed((keys * np.uint64(0x9E3779B97F4A7C15)) ^ column)
    return keys.view(np.int64)


@cache
def least_matches(percent: int) -> list[int]:
    """For each batch the fewest matches with which a pair goes on.

    After m matches of n the posterior from a uniform prior is Beta(m + 1, n - m + 1), whose part above t is the
    chance of at most m successes in n + 1 trials of chance t.
    """
    t, least = percent / 100, []
    for n in range(BATCH, KEPT + 1, BATCH):
        tail, m = 0.0, -1
        while tail < MISS:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        least.append(m)
    return least


def sets(docs: DataFrame, size: int, signed: bool) -> DataFrame:
    """(doc_id, n, digest and, if ``signed``, bands and signature, else the sorted set) of every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, digest, bands, kept, full = [], [], [], [], []
            for text in batch["text"].to_pylist():
                members = np.unique(shingles(hashes((text or "").encode().lower().split()), size))
                n.append(len(members))
                digest.append(xxhash.xxh3_128_digest(members.tobytes()))
                if not signed:
                    full.append(members.tobytes())
                    continue
                best = signature(members) if len(members) else np.zeros(BANDS * ROWS, np.uint32)
                bands.append(band_keys(best))
                kept.append(best[:KEPT].astype(np.uint16).tobytes())
            columns = {"doc_id": batch["doc_id"], "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary())}
            if signed:
                flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
                offsets = pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32))
                columns |= {
                    "bands": pa.ListArray.from_arrays(offsets, pa.array(flat)),
                    "kept": pa.array(kept, pa.binary()),
                }
            else:
                columns["members"] = pa.array(full, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    shape = "bands array<long>, kept binary" if signed else "members binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, f"doc_id long, n long, digest binary, {shape}")


def posterior_filter(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures do not rule the threshold out."""
    least = least_matches(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, KEPT) for c in ("kept_a", "kept_b")
            )
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, bound in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (left[alive, cut] == right[alive, cut]).sum(axis=1)
                alive = alive[matches[alive] >= bound]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    a = signs.select(F.col("id").alias("a"), F.col("kept").alias("kept_a"))
    b = signs.select(F.col("id").alias("b"), F.col("kept").alias("kept_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "kept_a", "kept_b").mapInArrow(compare, "a long, b long")


def verify(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) confirmed on their full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch["members_a"].to_pylist(), batch["members_b"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    a = members.select(F.col("id").alias("a"), F.col("members").alias("members_a"))
    b = members.select(F.col("id").alias("b"), F.col("members").alias("members_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "members_a", "members_b").mapInArrow(confirm, "a long, b long")


def _near_size(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can reach the threshold."""
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (a > 0) & (b > 0)


def _crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    a = labels.select(F.col("id").alias("a"), F.col("cluster").alias("_ca"))
    b = labels.select(F.col("id").alias("b"), F.col("cluster").alias("_cb"))
    return (
        pairs.join(a, "a", "left").join(b, "b", "left")
        .filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")
    )


def links_across(open_: DataFrame, signs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join the components (``comp``) of each bucket.

    ``open_`` has (band, id, n, comp, minor, most) and per bucket the rows ``held`` and its minor rows ``strays``; ``most``
    is its largest component. Minor rows are compared with all rows, both cut into a power of two of blocks of up to
    ``BLOCK`` rows, every pair of blocks in one place: signatures by batches, then full sets, best estimate first, where
    pairs already joined there are passed over. Only confirmed links leave a task, at most one per row. Buckets around
    one component hold nearly the same documents, so equal block pairs of up to ``SHARED_ROWS`` of their rows share a
    group, which gets each document once; other buckets share a group too, ``GROUP_ROWS`` rows being its aim.
    """

    def blocks(count: str):
        return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col(count) / BLOCK, F.lit(1.0))))).cast("int")

    def numbered(count: str):
        return F.sequence(F.lit(0), F.col(count) - 1)

    def place(count: str):
        return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")

    def as_row(lo, hi, side: bool):
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(side).alias("asks"))

    open_ = open_.withColumn("los", blocks("strays")).withColumn("his", blocks("held"))
    others = F.transform(numbered("los"), lambda k: as_row(k, place("his"), False))
    asking = F.when(F.col("minor"), F.transform(numbered("his"), lambda k: as_row(place("los"), k, True)))
    paired = open_.select(
        "band", "id", "n", "comp", "most", "los", "his",
        F.explode(F.concat(others, F.coalesce(asking, F.slice(others, 1, 0)))).alias("_at"),
    ).select("band", "id", "n", "comp", "most", "los", "his", "_at.*")
    around = ["most", "los", "his", "lo", "hi"]
    sizes = cut_lineage(paired.groupBy(*around).agg(F.count("*").alias("_n")))
    groups = int((sizes.agg(F.sum("_n")).first()[0] or 0) // GROUP_ROWS) + 1
    share = F.pmod(F.xxhash64("band"), F.ceil(F.col("_n") / SHARED_ROWS))
    unit = F.pmod(F.xxhash64(*around, share), F.lit(groups))
    once = paired.join(sizes, around).groupBy(unit.alias("unit"), "id").agg(
        F.first("n").alias("n"), F.first("comp").alias("comp"), F.collect_list(F.struct("band", "lo", "hi", "asks")).alias("places")
    )
    wanted = open_.select("id").distinct()
    signed = signs.join(wanted, "id", "left_semi").select("id", "kept", "bands")
    rows = once.join(signed, "id").join(members.select("id", "members"), "id")
    least = least_matches(percent)

    def compare(group: pa.Table) -> pa.Table:
        found: set[tuple[int, int]] = set()
        group = group.combine_chunks()
        unit = {c: group[c].to_numpy() for c in ("id", "n", "comp")}
        unit["kept"] = np.frombuffer(b"".join(group["kept"].to_pylist()), np.uint16).reshape(-1, KEPT)
        unit["bands"] = group["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        lists = group["places"].combine_chunks()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        at = lists.flatten()
        asks = at.field("asks").to_numpy(zero_copy_only=False)
        places = np.stack([at.field(c).to_numpy().astype(np.int64) for c in ("band", "lo", "hi")], axis=1)
        keys, which = np.unique(places, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        ends = np.flatnonzero(np.diff(which.ravel()[order])) + 1
        for key, part in zip(keys, np.split(order, ends), strict=True):
            found |= _join_bucket(int(key[0]), unit, group["members"], row[part[asks[part]]], row[part[~asks[part]]], least, percent)
        a, b = zip(*sorted(found), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("unit").applyInArrow(compare, "a long, b long").distinct()


def _join_bucket(
    band: int, unit: dict[str, np.ndarray], members: pa.ChunkedArray, asking: np.ndarray, held: np.ndarray, least: list[int], percent: int
) -> set[tuple[int, int]]:
    """Confirmed links between different components of one pair of blocks of a bucket."""
    ids, n, comp, kept, bands = (unit[c] for c in ("id", "n", "comp", "kept", "bands"))
    pairs: list[tuple[int, int, int]] = []
    for i in asking:
        at = int((bands[i] == band).argmax())
        j = held[(comp[held] != comp[i]) & (100 * np.minimum(n[held], n[i]) >= percent * np.maximum(n[held], n[i]))]
        matches = np.zeros(len(j), np.int64)
        for k, bound in enumerate(least):
            if not len(j):
                break
            matches += (kept[j, k * BATCH : (k + 1) * BATCH] == kept[i, k * BATCH : (k + 1) * BATCH]).sum(axis=1)
            j, matches = j[matches >= bound], matches[matches >= bound]
        if len(j):  # a pair belongs to the first band that it shares
            own = (bands[j] == bands[i]).argmax(axis=1) == at
            pairs += [(-int(m), int(i), int(x)) for m, x in zip(matches[own], j[own], strict=True)]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    found = set()
    for _, i, j in sorted(pairs):
        x, y = find(int(comp[i])), find(int(comp[j]))
        if x == y:
            continue
        left, right = (np.frombuffer(members[k].as_py(), np.uint64) for k in (i, j))
        common = len(np.intersect1d(left, right, assume_unique=True))
        if 100 * common >= percent * (len(left) + len(right) - common):
            root[x] = y
            found.add((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
    return found


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    # Rows are told apart by number: an id may be null, or stand before several texts.
    signs = cut_lineage(sets(docs, size, signed=True).withColumn("id", F.monotonically_increasing_id()))
    # Equal sets are linked through the smallest row of their class; empty sets stand alone.
    small = signs.select("id", "doc_id", "n", "digest")
    copied = small.filter("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("_n"))
    classes = cut_lineage(copied.filter("_n > 1").drop("_n"))
    of_class = cut_lineage(small.join(classes, "digest", "left").select("id", "doc_id", "n", "digest", F.coalesce("rep", "id").alias("rep")))

    alone = of_class.filter((F.col("id") == F.col("rep")) & (F.col("n") > 0)).select("id").distinct()
    reps = signs.filter("n > 0").join(alone, "id", "left_semi")
    bands = cut_lineage(reps.select("id", "n", F.explode("bands").alias("band")))
    shared = bands.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("_last"), F.count("*").alias("held")).filter("hub != _last")
    crowded = cut_lineage(bands.join(shared.select("band", "hub", "held"), "band"))
    hub_size = alone_sizes(of_class).select(F.col("id").alias("hub"), F.col("n").alias("_hub_n"))
    stars = (
        crowded.filter("id != hub").select("hub", "id", "n").distinct().join(hub_size, "hub")
        .filter(_near_size(F.col("n"), F.col("_hub_n"), percent)).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    )
    first = cut_lineage(posterior_filter(stars, signs, percent))

    # Full sets of the documents that a survivor or a bucket of more than one pair may need.
    more = crowded.filter("held > 2").select("band", "id", "n")
    needed = first.select(F.explode(F.array("a", "b")).alias("id")).unionByName(more.select("id")).distinct()
    needed = cut_lineage(small.join(needed, "id", "left_semi"))
    again = docs.join(needed.select(F.col("doc_id").alias("_needed")).distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("_needed")), "left_semi")
    members = sets(again, size, signed=False).select("digest", "members").join(needed.select("id", "digest"), "digest")
    members = cut_lineage(members.dropDuplicates(["id"]).select("id", "members"))
    one_each = first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = cut_lineage(verify(one_each, members, percent))
    rest = _crossing(first.join(one_each, ["a", "b"], "left_anti"), _components(links))
    links = cut_lineage(links.unionByName(verify(rest, members, percent)))

    labels = _components(links)
    open_ = more.join(labels, "id", "left").withColumn("comp", F.coalesce("cluster", "id")).drop("cluster")
    # The largest component of a bucket needs no comparison inside; ``minor`` rows are all others.
    largest = open_.groupBy("band", "comp").agg(F.count("*").alias("_n")).groupBy("band").agg(
        F.max_by("comp", F.struct("_n", "comp")).alias("_most"), F.max("_n").alias("_most_n"), F.sum("_n").alias("held")
    ).filter("_most_n < held").select("band", "_most", "held", (F.col("held") - F.col("_most_n")).alias("strays"))
    open_ = cut_lineage(open_.join(largest, "band").withColumn("minor", F.col("comp") != F.col("_most")).withColumnRenamed("_most", "most"))
    across = cut_lineage(links_across(open_, signs, members, percent))
    if not across.isEmpty():
        labels = _components(links.unionByName(across))
    # Rows with one id and different sets are linked too.
    filled = of_class.filter("n > 0")
    of_id = filled.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_last")).filter("a != _last")
    through = cut_lineage(filled.join(of_id.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).filter("a != b").distinct())
    if not through.isEmpty():
        at = labels.select(F.col("id").alias("a"), F.col("cluster").alias("_a"))
        to = labels.select(F.col("id").alias("b"), F.col("cluster").alias("_b"))
        joined = through.join(at, "a", "left").join(to, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        merged = _components(joined.filter("a != b")).withColumnsRenamed({"id": "_old", "cluster": "_new"})
        labels = filled.select(F.col("rep").alias("id")).distinct().join(labels, "id", "left").withColumn("_old", F.coalesce("cluster", "id"))
        labels = labels.join(merged, "_old", "left").select("id", F.coalesce("_new", "_old").alias("cluster"))
    # The name of a component is its smallest document id: of its classes first, then of all.
    labels = labels.select(F.col("id").alias("rep"), "cluster")
    of_rep = of_class.groupBy("rep").agg(F.min("doc_id").alias("_least")).join(labels, "rep", "left")
    of_rep = cut_lineage(of_rep.withColumn("cluster", F.coalesce("cluster", "rep")))
    names = of_rep.groupBy("cluster").agg(F.min("_least").alias("component_id"))
    named = cut_lineage(of_rep.join(names, "cluster").select("rep", "component_id"))
    return of_class.join(named, "rep").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def alone_sizes(of_class: DataFrame) -> DataFrame:
    """(id, n) of class representatives."""
    return of_class.filter("id = rep").groupBy("id").agg(F.max("n").alias("n"))

"""The trie of conversation prefixes, as one row per distinct prefix.

``rebuilt`` numbers the turns of every conversation and lets groups of conversations share their first turns.
``nodes`` enumerates the distinct prefixes by digests: the digest of a prefix is the exclusive or of one 128-bit hash
per (turn, depth), so it comes from a running aggregate and a conversation of any length is cut into blocks of
``BLOCK`` turns that carry one small row to the next. Every prefix with one digest must have one parent and one last
turn (128 bits of sha256); otherwise all is done again with other hashes.

Each node belongs to its smallest member. Shards hold whole (conversation, block) cells. A shard gives its distinct
prefixes the slots of a minimal perfect hash, verifies every slot against the digests, scatters what its
conversations own into flat arrays, and adds the arrays up along parent slots, deepest first. All ancestors of a node
within a block are on its owner's path and so in the same shard; what lies in deeper blocks enters as the carry of
the last turn of the block. Totals of the shards meet by digest, combined before the shuffle.

Digests of member lists are folded in order of ids by one streaming pass per partition, from pieces that the tasks of
a range sort have joined; the sha256 of one list is sequential by definition, with constant memory.

Defined cases: rows without a conversation id belong to none; null roles and texts are empty; turns of one number
are ordered by the digest of role and text, and repeated rows are turns of their own; a conversation without
turns left is a member of the root alone; further columns are ignored; no conversations give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammertrail.llm.common import mixed, prepare, with_positions
from hammertrail.llm.mph import PerfectHash
from hammertrail.session import cut_lineage

#: Turns of one conversation in a cell, and rows of a shard.
BLOCK_BITS = 16
SHARD_ROWS = 1 << 16
MIN_SHARDS = 64
#: Parents of more than one in so many nodes are looked up in place; there are at most so many.
HEAVY = 2000
SEEDS = 8

NODE = ["depth", "p1", "p2"]
TOTALS = "depth long, p1 long, p2 long, saved_tokens long, n_leaves long"
LISTS = "depth long, p1 long, p2 long, first long, ids string"
ENDS = "depth long, p1 long, p2 long, ends_sha256 string"


def rebuilt(conversations: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Turns (conv_id, depth from 1, t1, t2, bytes, last) after conversations of one family share their first turns,
    and a row of depth 0 for each conversation. The first crc32(id) mod ``heads`` turns come from the conversation
    that opens the family (id - id mod ``family``); t1 and t2 stand for role and text."""
    prepare(conversations.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = cut_lineage(
        conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", sha.alias("sha"), F.octet_length(text).cast("long").alias("bytes"))
    )
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    info = lengths.withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, "base": F.col("conv_id") - F.col("conv_id") % family,
    })
    info = cut_lineage(
        info.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
        .withColumn("shared", F.when(F.col("conv_id") == F.col("base"), F.col("h")).otherwise(F.least("h", F.coalesce("base_n", F.lit(0)))))
        .withColumn("length", F.when(F.col("conv_id") == F.col("base"), F.col("n")).otherwise(F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    )
    placed = cut_lineage(with_positions(turns, ["conv_id"], ["turn", "sha"], info))
    opens = F.col("conv_id") == F.col("base")
    own = placed.filter(opens | (F.col("position") >= F.col("h"))).select(
        "conv_id", "length", "sha", "bytes", (F.col("position") + 1 - F.col("h") + F.col("shared")).alias("depth")
    )
    members = info.filter(~opens).select("base", "conv_id", "h", "length")
    copied = placed.filter(opens & (F.col("position") < heads - 1)).select("base", "sha", "bytes", "position").join(members, "base")
    copied = copied.filter("position < h").select("conv_id", "length", "sha", "bytes", (F.col("position") + 1).alias("depth"))
    tops = info.select("conv_id", "length", F.lit(None).cast("string").alias("sha"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("depth"))

    def half(start: int) -> Column:
        return F.coalesce(F.conv(F.substring("sha", start, 16), 16, -10).cast("long"), F.lit(0).cast("long"))

    return own.unionByName(copied).unionByName(tops).select(
        "conv_id", "depth", half(1).alias("t1"), half(17).alias("t2"), "bytes", (F.col("depth") == F.col("length")).alias("last")
    )


def prefixes(turns: DataFrame, seed: int) -> DataFrame:
    """``turns`` with ``block``, the digest (p1, p2) of the prefix that ends there, and that of its parent (q1, q2)."""
    deep = F.col("depth") > 0
    lanes = {f"k{i}": F.when(deep, F.xxhash64("t1", "t2", "depth", F.lit(2 * seed + i))).otherwise(0) for i in (1, 2)}
    rows = turns.withColumn("block", F.shiftright("depth", BLOCK_BITS)).withColumns(lanes)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"))
    carry = blocks.select("conv_id", "block", F.bit_xor("k1").over(before).alias("c1"), F.bit_xor("k2").over(before).alias("c2"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"p{i}": F.bit_xor(f"k{i}").over(so_far) for i in (1, 2)})
    rows = rows.join(carry.filter("block > 0"), ["conv_id", "block"], "left")
    rows = rows.withColumns({f"p{i}": F.col(f"p{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))) for i in (1, 2)})
    return rows.withColumns({f"q{i}": F.when(deep, F.col(f"p{i}").bitwiseXOR(F.col(f"k{i}"))) for i in (1, 2)}).drop("k1", "k2", "c1", "c2")


def counted(paths: DataFrame) -> tuple[DataFrame, bool]:
    """One row per distinct prefix with its counts, and whether no two prefixes share a digest."""
    same = ["q1", "q2", "t1", "t2"]
    stats = cut_lineage(paths.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"),
        *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"{c}_max") for c in same],
    ))
    differs = F.lit(False)
    for c in same:
        differs = differs | (F.col(c) != F.col(f"{c}_max"))
    return stats.select(*NODE, "n_convs", "conv_id", "bytes", "q1", "q2"), stats.filter(differs).isEmpty()


class NodeTable:
    """Distinct prefixes of a shard in the slots of a minimal perfect hash, with their parent slots."""

    def __init__(self, depth: np.ndarray, p1: np.ndarray, p2: np.ndarray):
        self.salt = 0
        while True:
            self.hash = PerfectHash.build(self._keys(p1, p2))
            self.of_rows = self.hash(self._keys(p1, p2))
            self.depth, self.p1, self.p2 = (np.zeros(self.hash.size, np.int64) for _ in range(3))
            for target, values in ((self.depth, depth), (self.p1, p1), (self.p2, p2)):
                target[self.of_rows] = values
            if self._holds(self.of_rows, depth, p1, p2).all():
                return
            self.salt += 1

    def _keys(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        return mixed(p1.view(np.uint64) + np.uint64(self.salt)) ^ p2.view(np.uint64)

    def _holds(self, slots: np.ndarray, depth: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        return (self.depth[slots] == depth) & (self.p1[slots] == p1) & (self.p2[slots] == p2)

    def slots(self, depth: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """The slot of each prefix, -1 where the shard does not hold it."""
        found = self.hash(self._keys(p1, p2))
        return np.where((found >= 0) & self._holds(found, depth, p1, p2), found, -1)

    def accumulate(self, parents: np.ndarray, *sums: np.ndarray) -> None:
        """Add every slot to its parent slot, deepest first."""
        order = np.argsort(-self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        for level in np.split(order, cuts):
            level = level[parents[level] >= 0]
            for values in sums:
                np.add.at(values, parents[level], values[level])


def shard_totals(paths: pa.Table, owned: pa.Table) -> pa.Table:
    """Sums below every prefix of a shard, of what the conversations in it own."""
    names = TOTALS.replace(" long", "").split(", ")
    if not paths.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in names})
    conv, depth, p1, p2 = (paths[c].to_numpy() for c in ("conv_id", "depth", "p1", "p2"))
    q1, q2 = (paths[c].fill_null(0).to_numpy() for c in ("q1", "q2"))
    table = NodeTable(depth, p1, p2)
    parents = np.full(table.hash.size, -1, np.int64)
    parents[table.of_rows] = table.slots(depth - 1, q1, q2)
    # Rows of the shard by (conversation, depth), to find those that own something.
    order = np.lexsort((depth, conv))
    convs, at = np.unique(conv[order], return_inverse=True)
    keys = (at.astype(np.int64) << 40) | depth[order]
    own = (np.searchsorted(convs, owned["owner"].to_numpy()) << 40) | owned["at"].to_numpy()
    slots = table.of_rows[order[np.searchsorted(keys, own)]]
    saved, leaves = (np.zeros(table.hash.size, np.int64) for _ in range(2))
    np.add.at(saved, slots, owned["saved"].to_numpy())
    np.add.at(leaves, slots, owned["leaves"].to_numpy())
    table.accumulate(parents, saved, leaves)
    return pa.table([table.depth, table.p1, table.p2, saved, leaves], names=names)


def subtree_totals(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``saved_tokens`` and ``n_leaves`` of every prefix."""
    owned = nodes.select(
        "conv_id", "depth", F.shiftright("depth", BLOCK_BITS).alias("block"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
    )
    # What a conversation owns in deeper blocks enters at the last turn of each block before.
    long = paths.groupBy("conv_id").agg(F.max("block").alias("top")).filter("top > 0")
    cells = long.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("block"))
    sums = owned.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.join(sums, ["conv_id", "block"], "left").select(
        "conv_id", F.shiftleft(F.col("block") + 1, BLOCK_BITS).alias("end"), "block",
        F.sum("saved").over(deeper).alias("saved"), F.sum("leaves").over(deeper).alias("leaves"),
    ).filter("leaves IS NOT NULL OR saved IS NOT NULL")
    carry = carry.select(
        "conv_id", (F.col("end") - 1).alias("depth"), "block", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaves", F.lit(0)).alias("leaves")
    )
    shards = max(MIN_SHARDS, paths.count() // SHARD_ROWS + 1)
    shard = F.pmod(F.xxhash64("conv_id", "block"), F.lit(shards)).alias("shard")
    left = paths.select(shard, "conv_id", "depth", "p1", "p2", "q1", "q2")
    right = owned.unionByName(carry).select(shard.alias("to"), F.col("conv_id").alias("owner"), F.col("depth").alias("at"), "saved", "leaves")
    made = left.groupBy("shard").cogroup(right.groupBy("to")).applyInArrow(shard_totals, TOTALS)
    return made.groupBy(*NODE).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one prefix that stand together in a batch, joined with commas."""
    for batch in batches:
        depth, p1, p2, ids = (batch[c].to_numpy() for c in (*NODE, "conv_id"))
        starts = np.flatnonzero(np.r_[len(ids) > 0, (np.diff(p1) != 0) | (np.diff(p2) != 0) | (np.diff(depth) != 0)])
        texts = [",".join(map(str, run)) for run in np.split(ids, starts[1:])] if len(ids) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (depth[starts], p1[starts], p2[starts], ids[starts])] + [pa.array(texts, pa.string())],
            ["depth", "p1", "p2", "first", "ids"],
        )


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the pieces of each prefix, which come one after the other."""
    def out(rows):
        return pa.RecordBatch.from_arrays(
            [*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())],
            [*NODE, "ends_sha256"],
        )

    at, state = None, None
    for batch in batches:
        rows = []
        for *key, ids in zip(*(batch[c].to_pylist() for c in (*NODE, "ids")), strict=True):
            if key == at:
                state.update(f",{ids}".encode())
                continue
            if at:
                rows.append((*at, state.hexdigest()))
            at, state = key, hashlib.sha256(ids.encode())
        yield out(rows)
    if at:
        yield out([(*at, state.hexdigest())])


def member_lists(paths: DataFrame) -> DataFrame:
    """``ends_sha256`` of every prefix at which a conversation ends."""
    ends = paths.filter("last").select(*NODE, "conv_id")
    pieces = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_pieces, LISTS)
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_folded, ENDS)


def nodes(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt ``turns``, the empty one included."""
    turns = cut_lineage(turns)
    for seed in range(SEEDS):
        paths = cut_lineage(prefixes(turns, seed))
        found, distinct = counted(paths)
        if distinct:
            break
    else:
        raise ValueError(f"different prefixes share digests under {SEEDS} hash functions")
    children = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    children = children.agg(F.count("*").alias("n_children"))
    known = cut_lineage(found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = known.select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    hot = F.col("n_children") * HEAVY > known.count()
    key = ["depth", "q1", "q2"]
    # At most HEAVY rows: the children of all parents are no more than the nodes.
    near = known.join(F.broadcast(parents.filter(hot).drop("n_children")), key, "left")
    far = near.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(parents.filter(~hot).drop("n_children"), key, "left")
    linked = near.filter("parent_conv_id IS NOT NULL").unionByName(far)
    made = linked.join(subtree_totals(paths, known), NODE).join(member_lists(paths), NODE, "left")
    return made.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )

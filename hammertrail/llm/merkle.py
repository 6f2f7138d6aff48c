"""Merkle manifest of a dataset: one tree per language, one root over all, and a proof for every row.

Levels are built bottom up by grouping every eight consecutive nodes, and stored as node rows that hold the digests
of their children, the id of their parent and their place below it. A recursive query then climbs from the leaves to
the root: at each node it puts the digests carried along in the place of the child it came from, hashes the run anew
and appends the other children to the proof. The leaves of one run share a row of the recursion, since all nodes
above their run are the same; each leaf's digest is folded by itself.

Leaves are numbered by one range sort, so a language with most rows spreads over all tasks. The recursion joins on
(tree, block of 4096 leaves, node); nodes above a block are stored once per block, so that no node gathers all
leaves. Digests are carried as 32 bytes and hashed as hex text. A lost executor costs at most one written level or
one round of the recursion.

Defined cases: null fields count as ``-``; rows without an id come first in their tree and are never tampered with;
equal ids are ordered by their leaf, and rows equal in all fields stand side by side; null is a language of its own;
further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammertrail.llm.common import prepare, with_positions
from hammertrail.session import cut_lineage

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
#: Leaves of a block, as a number of levels: nodes above are stored once per block.
BLOCK_LEVELS = 4
BLOCK_BITS = ARITY_BITS * BLOCK_LEVELS
#: Node ids within a path are the level in the upper bits and the index in the lower ones.
INDEX_BITS = 48

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree, block, subroot, ids, leaves, beside, folded, siblings, parent, place FROM {runs}
  UNION ALL
  SELECT tree, block, subroot, ids, leaves, beside,
         transform(folded, f -> unhex(sha2(lower(hex(concat(before, f, after))), 256))),
         concat(siblings, before, after), next_parent, next_place
  FROM (
    SELECT c.*, substring(n.children, 1, 32 * c.place) AS before, substring(n.children, 32 * c.place + 33) AS after,
           n.parent AS next_parent, n.place AS next_place
    FROM climb c JOIN {nodes} n ON n.tree = c.tree AND n.block = c.block AND n.node = c.parent
  )
)
SELECT * FROM climb WHERE parent IS NULL"""


def digest(*parts: Column) -> Column:
    """sha256 of the concatenated texts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): the digest of each row, and of the row as tampering leaves it."""
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = digest(*head, field(F.col("text")))
    lowered = digest(*head, field(F.translate("text", UPPER, LOWER)))
    changed = touched & F.col("text").rlike("[A-Z]")
    return docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(changed, lowered).alias("tampered"))


def level_above(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, index, digest, n) of trees with more than one node, hashed in runs; ``children`` are their digests."""
    run = F.shiftright("index", ARITY_BITS)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "digest"))), lambda r: hex_text(r["digest"])), "")
    return (
        nodes.filter("n > 1").groupBy("tree", run.alias("above"), F.shiftright(F.col("n") + ARITY - 1, ARITY_BITS).alias("above_n"))
        .agg(text.alias("text"))
        .select(
            "tree", F.col("above").alias("index"), F.unhex(F.sha2("text", 256)).alias("digest"),
            F.col("above_n").alias("n"), F.unhex("text").alias("children"),
        )
    )


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = (n + ARITY - 1) // ARITY, levels + 1
    return levels


def built_levels(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """All levels above ``nodes``, each written to the shared folder."""
    levels = []
    for _ in range(height(largest)):
        nodes = cut_lineage(level_above(nodes))
        levels.append(nodes)
    return levels


def node_id(level: Column, index: Column) -> Column:
    return F.shiftleft(level.cast("long"), INDEX_BITS).bitwiseOR(index)


def proofs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and ``proof``, the
    digests of the proof one after the other (32 bytes each)."""
    spark = prepare(docs.sparkSession)
    leaves = cut_lineage(leaf_rows(docs))
    trees = cut_lineage(with_positions(leaves.groupBy("lang").agg(F.count("*").alias("n")), [], ["lang"]).withColumnRenamed("position", "tree"))
    n_trees, largest = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    low, high = height(largest), height(n_trees)
    # Levels of one tree, which depend on its number of leaves alone.
    levels = sum((F.when(F.col("n") > ARITY**k, 1).otherwise(0) for k in range(low)), F.lit(0))
    placed = cut_lineage(
        with_positions(leaves, ["lang"], ["doc_id", "leaf"], trees)
        .select("doc_id", "leaf", "tampered", "tree", "n", F.col("position").alias("index"))
    )
    built = built_levels(placed.select("tree", "index", F.col("leaf").alias("digest"), "n"), largest)
    alone = placed.filter("n = 1").select("tree", F.col("leaf").alias("digest"))
    for level in built:
        alone = alone.unionByName(level.filter("n = 1").select("tree", "digest"))
    tops = cut_lineage(
        alone.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("index"), "digest", F.lit(n_trees).cast("long").alias("n"))
    )
    upper = built_levels(tops, n_trees)
    root = (upper[-1] if upper else tops).select(F.lower(F.hex("digest"))).first() if n_trees else None

    info = trees.withColumn("levels", levels)
    subroots = tops.select(F.col("index").alias("tree"), F.col("digest").alias("subroot"))
    blocks = cut_lineage(
        info.join(subroots, "tree")
        .select("tree", "levels", "subroot", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, BLOCK_BITS))).alias("block"))
    )

    def linked(rows: DataFrame, level: Column) -> DataFrame:
        """``rows`` with ``node``, its ``parent`` and its ``place`` below it, from tree, block, levels and index."""
        # The root of one tree is the node with the number of the tree below the upper levels.
        index = F.when(level == F.col("levels"), F.col("tree")).otherwise(F.col("index"))
        parent = F.when(level < F.col("levels") + high, node_id(level + 1, F.shiftright(index, ARITY_BITS)))
        return rows.withColumns({
            "node": node_id(level, F.col("index")), "parent": parent, "place": index.bitwiseAND(ARITY - 1).cast("int"),
        })

    paths = []
    for k, level in enumerate(built, 1):
        here = level.select("tree", "index", "children")
        if k <= BLOCK_LEVELS:
            here = here.withColumn("block", F.shiftright("index", BLOCK_BITS - ARITY_BITS * k)).join(blocks, ["tree", "block"])
        else:
            own = blocks.filter(F.col("levels") >= k).withColumn("index", F.shiftright("block", ARITY_BITS * (k - BLOCK_LEVELS)))
            here = own.join(here, ["tree", "index"])
        paths.append(linked(here, F.lit(k)))
    for j, level in enumerate(upper, 1):
        here = level.select("index", "children")
        own = blocks.withColumn("index", F.shiftright("tree", ARITY_BITS * j))
        paths.append(linked(own.join(here, "index"), F.col("levels") + j))

    nodes = spark.createDataFrame([], "tree long, block long, node long, children binary, parent long, place int")
    for path in paths:
        nodes = nodes.unionByName(path.select(nodes.columns))
    climbed = _climb(cut_lineage(linked(_runs(placed, blocks), F.when(F.col("levels") == 0, 0).otherwise(1))), cut_lineage(nodes))
    return _finished(climbed, root[0] if root else None)


def _runs(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per run of leaves. The first step of the climb needs no join, since a run holds all its leaves."""
    member = F.struct("index", "doc_id", "leaf", F.coalesce("tampered", "leaf").alias("tampered"))
    others = "transform(run, (r, i) -> array_join(transform(run, (s, j) -> lower(hex({}))), ''))"
    folded = others.format("if(i = j, s.tampered, s.leaf)")
    beside = others.format("if(i = j, X'', s.leaf)")
    return (
        placed.groupBy("tree", F.shiftright("index", ARITY_BITS).alias("index")).agg(F.sort_array(F.collect_list(member)).alias("run"))
        .withColumn("block", F.shiftright("index", BLOCK_BITS - ARITY_BITS)).join(blocks, ["tree", "block"])
        .withColumns({
            "ids": F.expr("transform(run, r -> r.doc_id)"),
            "leaves": F.expr("transform(run, r -> r.leaf)"),
            "beside": F.expr(f"transform({beside}, x -> unhex(x))"),
            "folded": F.when(F.col("levels") == 0, F.expr("transform(run, r -> r.tampered)"))
            .otherwise(F.expr(f"transform({folded}, x -> unhex(sha2(x, 256)))")),
            "siblings": F.expr("X''"),
        })
        .drop("run")
    )


def _climb(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The runs as they arrive at the root."""
    spark = runs.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    # The recursion makes one row per run and level; the limit guards against endless ones, and this one ends at the root.
    spark.conf.set(limit, "-1")
    try:
        return cut_lineage(spark.sql(CLIMB, runs=runs, nodes=nodes))
    finally:
        spark.conf.set(limit, before)


def _finished(climbed: DataFrame, root: str | None) -> DataFrame:
    """One row per leaf of the climbed runs."""
    member = F.explode(F.arrays_zip("ids", "leaves", "beside", "folded"))
    rows = climbed.select("subroot", "siblings", member.alias("m"))
    proof = F.concat("m.beside", "siblings")
    folded = hex_text(F.col("m.folded"))
    return rows.select(
        F.col("m.ids").alias("doc_id"), hex_text(F.col("m.leaves")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"),
        F.lit(root).cast("string").alias("root"), F.sha2(hex_text(proof), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.lit(root)).alias("verified"), proof.alias("proof"),
    )

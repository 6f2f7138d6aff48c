"""Line dedup: documents probe sharded minimal perfect hashes of the frequent lines.

The key of a line is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lowered. A key of at
least ``min_chars`` code points that ``min_docs`` documents hold keeps its lines only in the document with the
largest id. Counts come from one combined aggregate of 128-bit key hashes. The frequent keys are cut into
shards by hash; each shard is one row with a minimal perfect hash, fingerprints, counts and the largest ids as
flat arrays, and the hashes of the documents travel to their shard and probe the arrays. Keys in more than one
in ``HEAVY`` of all (document, key) rows, at most ``HEAVY`` by counting, form one more small index that every
task probes in place, so that no frequent line gathers its documents in one shard.

Defined cases: a null text is an empty text; rows with one id are one document, and keep or lose a line together;
all rows without an id count as one document more; a null id is smaller than any other, and lines found only in rows without an id stay; further
columns pass through, except that ``n_lines`` and ``n_dropped`` are replaced; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hammertrail.llm.common import mixed
from hammertrail.llm.mph import PerfectHash
from hammertrail.session import cut_lineage

BLANK = " \t\n\x0b\x0c\r"
#: Bound of the keys that every task probes in place.
HEAVY = 2000
#: Shards: at least this many, and one for this many (document, key) rows.
MIN_SHARDS, SHARD_ROWS = 256, 1 << 16

KEY_ROWS = "doc_id long, h1 long, h2 long"
SHARD_ROW = "shard long, perfect_hash binary, fingerprints binary, counts binary, last_ids binary"


def key_of(line: str, min_chars: int) -> tuple[int, int] | None:
    """Two 64-bit hashes of a line's key, or None for a key that is too short."""
    key = line.strip(BLANK)
    if len(key) < min_chars:
        return None
    both = xxhash.xxh3_128_intdigest(key.encode().lower())
    return both >> 64, both & 0xFFFFFFFFFFFFFFFF


class LineIndex:
    """Fingerprints, counts and largest ids of frequent keys, addressed by a minimal perfect hash."""

    def __init__(self, perfect_hash: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, last_ids: np.ndarray):
        self.perfect_hash, self.fingerprints, self.counts, self.last_ids = perfect_hash, fingerprints, counts, last_ids

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last_ids: np.ndarray) -> LineIndex:
        perfect_hash = PerfectHash.build(h1.view(np.uint64))
        at = perfect_hash(h1.view(np.uint64))
        made = [np.zeros(perfect_hash.size, kind) for kind in (np.int64, np.int32, np.int64)]
        for target, values in zip(made, (h2, np.minimum(counts, 2**31 - 1), last_ids), strict=True):
            target[at] = values
        return cls(perfect_hash, *made)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the index, and the largest id that holds each."""
        if not self.perfect_hash.size:
            return np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        at = self.perfect_hash(h1.view(np.uint64))
        found = (at >= 0) & (self.fingerprints[at] == h2)
        return found, self.last_ids[at]

    def to_row(self) -> list[bytes]:
        return [self.perfect_hash.to_bytes(), *(x.tobytes() for x in (self.fingerprints, self.counts, self.last_ids))]

    @classmethod
    def from_row(cls, blob: bytes, fingerprints: bytes, counts: bytes, last_ids: bytes) -> LineIndex:
        return cls(
            PerfectHash.from_bytes(blob), np.frombuffer(fingerprints, np.int64),
            np.frombuffer(counts, np.int32), np.frombuffer(last_ids, np.int64),
        )


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2), one row per document and distinct long key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, a, b = [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                keys = {key_of(line, min_chars) for line in set((text or "").split("\n"))} - {None}
                ids += [doc_id] * len(keys)
                a += [k[0] for k in keys]
                b += [k[1] for k in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b))],
                ["doc_id", "h1", "h2"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, KEY_ROWS)


def frequent_keys(keys: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n, last_id) of keys in at least ``min_docs`` documents."""
    return (
        # Two steps: the documents of a key first, so that a key in most of them is counted in many tasks.
        keys.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"))
        .filter((F.col("n") >= min_docs) & F.col("last_id").isNotNull())
    )


def build_shards(frequent: DataFrame) -> DataFrame:
    """One row per shard with the arrays of its keys."""

    def build(keys: pa.Table) -> pa.Table:
        h1, h2, n, last = (keys[c].to_numpy() for c in ("h1", "h2", "n", "last_id"))
        row = [keys["shard"][0].as_py(), *LineIndex.build(h1, h2, n, last).to_row()]
        return pa.table([[x] for x in row], schema=pa.schema(
            [("shard", pa.int64()), *((name, pa.binary()) for name in ("perfect_hash", "fingerprints", "counts", "last_ids"))]
        ))

    return frequent.groupBy("shard").applyInArrow(build, SHARD_ROW)


def _dropping(ids: pa.ChunkedArray | pa.Array, last: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Found keys in documents other than the one that keeps them."""
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    return found & (missing | (ids.fill_null(0).to_numpy(zero_copy_only=False) != last))


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, h1, h2) of the keys whose lines a document loses."""
    keys = cut_lineage(document_keys(docs, min_chars))
    frequent = cut_lineage(frequent_keys(keys, min_docs))
    total = keys.count()
    heavy = frequent.filter(F.col("n") * HEAVY > total)
    rows = heavy.toArrow()  # at most HEAVY rows: each stands for more than one in HEAVY of all key rows
    top = LineIndex.build(*(rows[c].to_numpy() for c in ("h1", "h2", "n", "last_id")))
    shards = max(MIN_SHARDS, total // SHARD_ROWS + 1)

    def probe_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch[c].to_numpy() for c in ("h1", "h2"))
            found, last = top.probe(h1, h2)
            drop = _dropping(batch["doc_id"], last, found)
            shard = (mixed(h1.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            out = pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["h1"], batch["h2"], pa.array(drop), pa.array(shard)],
                ["doc_id", "h1", "h2", "lost", "shard"],
            )
            yield out.filter(pa.array(drop | ~found))

    routed = keys.mapInArrow(probe_top, f"{KEY_ROWS}, lost boolean, shard long")

    def with_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = (mixed(batch["h1"].to_numpy().view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            yield batch.append_column("shard", pa.array(shard))

    index = build_shards(
        frequent.filter(F.col("n") * HEAVY <= total)
        .mapInArrow(with_shard, "h1 long, h2 long, n long, last_id long, shard long")
    )

    def probe(rows: pa.Table, shard: pa.Table) -> pa.Table:
        names = ["doc_id", "h1", "h2"]
        if not shard.num_rows or not rows.num_rows:
            return rows.select(names).slice(0, 0)
        arrays = LineIndex.from_row(*(shard[c][0].as_py() for c in SHARD_COLUMNS))
        found, last = arrays.probe(rows["h1"].to_numpy(), rows["h2"].to_numpy())
        return rows.select(names).filter(pa.array(_dropping(rows["doc_id"], last, found)))

    probed = routed.filter(~F.col("lost")).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, KEY_ROWS)
    return routed.filter("lost").select("doc_id", "h1", "h2").unionByName(probed)


SHARD_COLUMNS = ["perfect_hash", "fingerprints", "counts", "last_ids"]


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, and the long columns ``n_lines`` and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped")
    lost = repeated_lines(docs, min_chars, min_docs).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.col("h1")).alias("_lost1"), F.collect_list(F.col("h2")).alias("_lost2")
    )
    joined = docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left").drop("_id")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    names = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            texts, first, second = (batch[c].to_pylist() for c in ("text", "_lost1", "_lost2"))
            for text, a, b in zip(texts, first, second, strict=True):
                lines = (text or "").split("\n")
                stay = lines
                if a:
                    gone = set(zip(np.array(a, np.int64).view(np.uint64).tolist(), np.array(b, np.int64).view(np.uint64).tolist(), strict=True))
                    stay = [line for line in lines if key_of(line, min_chars) not in gone]
                kept.append("\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            out = batch.select(names)
            out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(kept, pa.string()))
            yield out.append_column("n_lines", pa.array(n_lines, pa.int64())).append_column("n_dropped", pa.array(n_dropped, pa.int64()))

    return joined.mapInArrow(rewrite, schema)

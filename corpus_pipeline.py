"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes the documents that the stage before it kept and returns documents with the same columns; the last
returns pieces of token sequences. ``run`` writes every stage as Parquet to the shared folder and reads it again, so
a lost executor costs at most one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammertrail.llm import line_dedup, minhash, mixing, packing, quality
from hammertrail.llm.common import prepare, table
from hammertrail.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned cutoffs keep."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share."""
    deduped = line_dedup.dedup_lines(docs)
    return deduped.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    kept = minhash.near_duplicates(docs, size=5, percent=80).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_kept")), "left_semi")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their targets."""
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of one length."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("minhash_dedup", near_deduplication),
    ("source_mixing", source_mixing),
    ("packing", sequence_packing),
]

#: SQL has neither the tokenizer nor the exact bounds of the quality rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs

"""Quality rules with risk-controlled thresholds.

Base rules reject short and repetitive texts. Beyond them each signal below gets one cutoff per stratum, which is a
language with labels, or null. On the labelled documents (``quality`` 1 is good) that pass the base rules, a cutoff is
admissible when the exact (Clopper-Pearson) upper bound of its false rejection rate is at most ``RISK`` divided by the
number of signals; the error of the bounds, ``ERROR``, is divided by the number of all bounds computed (Bonferroni), so
with probability 1 - ``ERROR`` every stratum loses at most ``RISK`` of its good documents. A stratum with few labels has
no admissible cutoff, and a language without labels no stratum: there the base rules decide alone. Of the admissible cutoffs the one with the best margin of bad
over good rejections is used, the most lenient on ties, and none when it gains nothing.

The labelled histograms cover all labelled rows; only they, languages x signals x buckets, reach the driver.

Defined cases: a null text has no words and fails the base rules; rows without label, or with a null label, do not
count; several labels of one id count each; without enough labels no cutoff is admissible and the base rules decide
alone; further columns pass through, except that the columns added here are replaced; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hammertrail.llm.common import WordHashes, shingles
from hammertrail.session import cut_lineage

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
RISK, ERROR = 0.05, 0.05
BUCKETS = 100
#: Good rejections weigh this many bad ones.
GOOD_WEIGHT = 20.0

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_marks"]


def counts(text: str, hashes: WordHashes) -> list[int]:
    """The counts of ``COUNTS`` for one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip(WHITE)]
    repeated = 0
    if n >= 4:
        _, inverse, times = np.unique(shingles(hashes(words), 3), return_inverse=True, return_counts=True)
        twice = np.zeros(n + 1, np.int32)
        at = np.flatnonzero(times[inverse] > 1)
        twice[at] += 1
        np.subtract.at(twice, at + 3, 1)
        repeated = int((np.cumsum(twice[:n]) > 0).sum())
    white = len(raw) - len(raw.translate(None, WHITE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    capitals = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    small = len(raw) - len(raw.translate(None, bytes(range(97, 123))))
    marks = len(raw) - len(raw.translate(None, b"!?"))
    return [n, len(text) - white, symbols, len(lines) - len(set(lines)), repeated, len(lines), capitals, capitals + small, marks]


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` and the counts of its texts."""
    docs = docs.drop(*COUNTS)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            made = np.array([counts(x or "", hashes) for x in batch["text"].to_pylist()], np.int64).reshape(-1, len(COUNTS))
            for k, name in enumerate(COUNTS):
                batch = batch.append_column(name, pa.array(made[:, k]))
            yield batch

    return docs.mapInArrow(rows, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def signals() -> dict[str, Column]:
    """Shares from 0 to 1, higher for worse texts."""

    def share(part: str, whole: str) -> Column:
        return F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))

    return {
        "symbols": share("n_symbols", "word_chars"), "symbols_per_word": share("n_symbols", "n_words"),
        "repeated_lines": share("n_dup_lines", "n_lines"), "repeated_words": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "n_letters"), "marks": share("n_marks", "n_words"),
    }


def binomial_tail(n: int, k: int, p: float) -> float:
    """Chance of at most ``k`` successes in ``n`` trials."""
    if k >= n:
        return 1.0
    terms = [
        lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)
    ]
    return min(1.0, sum(map(exp, terms)))


def admissible(n: int, k: int, risk: float, error: float) -> bool:
    """The exact upper bound of a rate with ``k`` of ``n`` seen is at most ``risk``."""
    return n > 0 and k < n and k <= risk * n and binomial_tail(n, k, risk) <= error


def choose_cutoffs(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Cutoffs, as buckets, from histograms (strata, signals, buckets); a text above its cutoff is rejected."""
    strata, kinds, buckets = good.shape
    error = ERROR / max(1, strata * kinds * buckets)
    cut = np.full((strata, kinds), buckets)
    for s in range(strata):
        for k in range(kinds):
            n, n_bad = int(good[s, k].sum()), max(1, int(bad[s, k].sum()))
            best = 0.0
            above_good = above_bad = 0
            for c in range(buckets - 2, -1, -1):
                above_good += int(good[s, k, c + 1])
                above_bad += int(bad[s, k, c + 1])
                if not admissible(n, above_good, RISK / kinds, error):
                    break
                gain = above_bad / n_bad - GOOD_WEIGHT * above_good / n
                if gain > best:
                    best, cut[s, k] = gain, c
    return cut


def bucket(share: Column) -> Column:
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def stratum() -> Column:
    """The language behind a mark that tells it from null."""
    return F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))


def learned_cutoffs(counted: DataFrame, labels: DataFrame) -> dict[str, list[int]]:
    """Cutoffs per stratum with labels, in the order of ``signals()``."""
    names = list(signals())
    marked = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_doc"), (F.col("quality") == 1).alias("good"))
    rows = counted.join(marked, F.col("doc_id") == F.col("_doc")).filter(~base_failed())
    cells = rows.select(
        stratum().alias("stratum"), "good",
        F.posexplode(F.array(*(bucket(x) for x in signals().values()))).alias("signal", "bucket"),
    ).groupBy("stratum", "good", "signal", "bucket").agg(F.count("*").alias("n")).collect()
    strata = sorted({r.stratum for r in cells})
    tables = np.zeros((2, len(strata), len(names), BUCKETS), np.int64)
    for r in cells:
        tables[int(r.good), strata.index(r.stratum), r.signal, r.bucket] += r.n
    cut = choose_cutoffs(tables[1], tables[0])
    return {name: cut[s].tolist() for s, name in enumerate(strata)}


def verdict(cutoffs: dict[str, list[int]]) -> Column:
    """The base rules pass and no signal lies above the cutoff of the row's stratum, if it has one."""
    if not cutoffs:
        return ~base_failed()
    table = F.create_map(*(x for name, cut in cutoffs.items() for x in (F.lit(name), F.array(*map(F.lit, cut)))))
    mine = F.coalesce(F.try_element_at(table, stratum()), F.array(*[F.lit(BUCKETS)] * len(signals())))
    over = [bucket(x) > mine[k] for k, x in enumerate(signals().values())]
    passes = ~base_failed()
    for x in over:
        passes = passes & ~x
    return passes


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row the counts, ``base_failed`` and ``kept``, without the texts."""
    counted = cut_lineage(with_counts(docs.select("doc_id", "lang", "text")).drop("text"))
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", verdict(learned_cutoffs(counted, labels)))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    counted = cut_lineage(with_counts(docs.select("doc_id", "lang", "text")).drop("text"))
    return with_counts(docs).filter(verdict(learned_cutoffs(counted, labels))).select(docs.columns)

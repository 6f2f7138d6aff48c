"""Join of texts that hold other texts, by an index of short character runs.

A text is posted under every run of up to ``RUN`` characters it holds. A sought text is looked up under the one of
its own runs that the fewest texts hold, and only texts posted there are compared with it. Texts and sought texts
meet within equal ``keys`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammertrail.session import cut_lineage

#: Longest run of characters that is indexed.
RUN = 3


def _runs(text: Column, width: int) -> Column:
    """The runs of ``width`` characters of a text, none for a shorter one."""
    starts = F.when(F.length(text) >= width, F.sequence(F.lit(1), F.length(text) - width + 1))
    return F.coalesce(F.transform(starts, lambda i: F.substring(text, i, F.lit(width))), F.array().cast("array<string>"))


def _posted(text: Column) -> Column:
    """All runs a text can be found under; '' finds every text."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_runs(text, w) for w in range(1, RUN + 1)]))


def _sought(text: Column) -> Column:
    """The runs of a sought text of which one is looked up; a short text is its own run."""
    return F.when(F.length(text) < RUN, F.array(text)).otherwise(F.array_distinct(_runs(text, RUN)))


#: Up to so many texts of equal keys are compared with every needle of the keys.
FEW_TEXTS = 64


def holding(sought: DataFrame, texts: DataFrame, keys: list[str], needle: str, text: str) -> DataFrame:
    """Distinct (``keys``, ``needle``, ``text``) where the text holds the needle.

    Exact: a run that no text of the keys holds rules its needle out, and every remaining pair is compared. NULL keys,
    needles and texts match nothing; an empty needle is held by every text. The cost is the number of runs plus, for
    each needle, the number of texts under its rarest run, which adaptive execution splits where a run is frequent.
    Keys of at most ``FEW_TEXTS`` texts need no index: comparing all of them costs a bounded number for each needle.
    """
    needles = cut_lineage(sought.select(*keys, needle).dropna().distinct())
    held = cut_lineage(texts.select(*keys, text).dropna().distinct())
    many = held.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > FEW_TEXTS).select(*keys)
    direct = needles.join(held.join(many, keys, "left_anti"), keys).filter(F.contains(text, needle))
    indexed = _looked_up(needles.join(many, keys, "left_semi"), held.join(many, keys, "left_semi"), keys, needle, text)
    return direct.select(*keys, needle, text).unionByName(indexed)


def _looked_up(needles: DataFrame, held: DataFrame, keys: list[str], needle: str, text: str) -> DataFrame:
    wanted = needles.select(*keys, needle, F.explode(_sought(F.col(needle))).alias("_run"))
    # Only runs that some needle asks for are counted and posted.
    asked = wanted.select(*keys, "_run").distinct()
    postings = held.select(*keys, text, F.explode(_posted(F.col(text))).alias("_run")).join(
        asked, [*keys, "_run"], "left_semi"
    )
    sizes = postings.groupBy(*keys, "_run").agg(F.count("*").alias("_size"))
    rarest = (
        wanted.join(sizes, [*keys, "_run"], "left")
        .groupBy(*keys, needle)
        .agg(F.min(F.struct(F.coalesce("_size", F.lit(0)).alias("size"), F.col("_run").alias("run"))).alias("_least"))
        .filter(F.col("_least.size") > 0)
        .select(*keys, needle, F.col("_least.run").alias("_run"))
    )
    found = rarest.join(postings, [*keys, "_run"])
    return found.filter(F.contains(text, needle)).select(*keys, needle, text)

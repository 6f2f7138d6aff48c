"""URL filter: site rules, and for all other URLs a character language model ratio, in DataFrame functions only.

The URLs that a rule accepts or rejects train two Markov models of characters. Their order varies with the context:
every context of up to ``ORDER`` characters is counted and interpolated with its shorter one by the Witten-Bell
estimate, so long contexts count where they were seen often and short ones elsewhere. URLs are folded first (A-Z
lowered, digits made 0, nothing before ``://``), and each distinct folded URL is counted and scored once.

The score of a URL is its log-likelihood under the accepted model minus that under the rejected one, divided by its
length. One in ``HELD_OUT`` of the folded URLs is not counted; on these the cutoff is calibrated as the one with the
best difference of accepted rates. Without held-out URLs of both kinds it is 0.

Defined cases: a null or empty URL has score 0; a URL without ``://`` has empty host and path and is scored as it
is; equal URLs are judged alike; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammertrail.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]
ORDER, HELD_OUT, ALPHABET = 4, 5, 256
#: Buckets of the score per unit, and the largest score told apart, for the calibration histogram.
FINE, WIDEST = 50, 20
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null without one."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(RULES, key=lambda r: len(r[0])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def folded(url: Column) -> Column:
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    return F.translate(rest, UPPER + "123456789", LOWER + "0" * 9)


def grams(text: Column) -> Column:
    """Every character with its ``ORDER`` characters before it; the ends are marked."""
    padded = F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def gram_ratios(urls: DataFrame) -> DataFrame:
    """(gram, ratio) of all grams of ``urls`` (folded, accepted, rejected, held_out): log P(accepted) - log P(rejected)."""
    every = urls.select("accepted", "rejected", "held_out", F.explode(grams(F.col("folded"))).alias("gram"))
    learn = ~F.col("held_out")
    seen = cut_lineage(every.groupBy("gram").agg(
        F.count_if(learn & F.col("accepted")).alias("a"), F.count_if(learn & F.col("rejected")).alias("b")
    ))
    suffix = F.transform(F.sequence(F.lit(0), F.lit(ORDER)), lambda k: F.substring(F.col("gram"), F.lit(ORDER + 1) - k, k + 1))
    tails = seen.select("gram", "a", "b", F.posexplode(suffix).alias("order", "tail"))
    counts = cut_lineage(tails.groupBy("order", "tail").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    contexts = counts.groupBy("order", F.expr("substring(tail, 1, order)").alias("context")).agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.count_if(F.col("a") > 0).alias("t_a"), F.count_if(F.col("b") > 0).alias("t_b")
    )
    steps = (
        tails.select("gram", "order", "tail", F.expr("substring(tail, 1, order)").alias("context"))
        .join(counts, ["order", "tail"]).join(contexts, ["order", "context"])
        .groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("order", "a", "b", "n_a", "n_b", "t_a", "t_b"))).alias("steps"))
    )

    def likelihood(c: str) -> Column:
        def deeper(p: Column, s: Column) -> Column:
            seen_here = s[f"n_{c}"] + s[f"t_{c}"]
            return F.when(seen_here > 0, (s[c] + s[f"t_{c}"] * p) / seen_here).otherwise(p)

        return F.aggregate("steps", F.lit(1.0 / ALPHABET), deeper)

    return steps.select("gram", (F.log(likelihood("a")) - F.log(likelihood("b"))).alias("ratio"))


def calibrated(scored: DataFrame) -> float:
    """The cutoff on held-out URLs: the middle of the best gap between accepted and rejected scores."""
    bucket = F.floor(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col("score"))) * FINE).cast("int")
    cells = (
        scored.filter(F.col("held_out") & (F.col("accepted") != F.col("rejected"))).groupBy(bucket.alias("bucket"))
        .agg(F.count_if("accepted").alias("a"), F.count_if("rejected").alias("b")).orderBy("bucket").collect()
    )  # at most 2 * WIDEST * FINE + 1 rows
    all_a, all_b = sum(r.a for r in cells), sum(r.b for r in cells)
    if not all_a or not all_b:
        return 0.0
    best, gap, below_a, below_b = 0.0, None, 0, 0
    for r, after in zip(cells, [*cells[1:], None], strict=True):
        below_a, below_b = below_a + r.a, below_b + r.b
        gain = below_b / all_b - below_a / all_a
        if after and gain > best:
            best, gap = gain, (r.bucket + 1, after.bucket)
    return 0.0 if gap is None else (gap[0] + gap[1]) / 2 / FINE


def judge(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"))
    rows = cut_lineage(rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), folded(F.col("url")).alias("folded")))
    urls = cut_lineage(
        rows.groupBy("folded").agg(
            F.max(F.coalesce(F.col("says") == "allow", F.lit(False))).alias("accepted"),
            F.max(F.coalesce(F.col("says") == "block", F.lit(False))).alias("rejected"),
        ).withColumn("held_out", F.crc32(F.col("folded").cast("binary")) % HELD_OUT == 0)
    )
    ratios = gram_ratios(urls)
    scored = cut_lineage(
        urls.select("*", F.explode(grams(F.col("folded"))).alias("gram")).join(ratios, "gram")
        .groupBy("folded", "accepted", "rejected", "held_out").agg(F.avg("ratio").alias("score"))
        .withColumn("score", F.when(F.col("folded") == "", F.lit(0.0)).otherwise(F.col("score")))
    )
    cutoff = calibrated(scored)
    model = F.when((F.col("folded") != "") & (F.col("score") < cutoff), "block").otherwise("allow")
    return rows.join(scored.select("folded", "score"), "folded").select(
        "page_id", "host", "path", "rule", F.coalesce("says", model).alias("verdict"), "score"
    )

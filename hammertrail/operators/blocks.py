"""Scores of similar items by blocks: all pairs of two bounded blocks at once, as arrays.

Items of comparable models are dealt into blocks of about ``BLOCK`` rows, and a task scores one pair of blocks after the
other. Pairs of small blocks share a group of about ``GROUP`` rows, so a group stays small however many items a model has.
The scores are those of :func:`hammertrail.operators.similar.similarity_score`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammertrail.functions import prices as P
from hammertrail.functions.text import blank_to_null
from hammertrail.session import cut_lineage

BLOCK, GROUP = 2048, 8192
# Scores held at once.
STRIP = 1 << 18

_EQUAL = ["_version", "_fuel", "_gear", "_color", "_engine", "_power"]
_NUMBERS = ["_year", "_km", "_ps", "_gate"]


def scored_keys(items: DataFrame) -> DataFrame:
    """Add the values that the scores compare; NULL is equal to nothing."""
    return items.withColumns(
        {
            "_brand": F.lower("brand"), "_model": F.lower("model"),
            "_version": F.lower(blank_to_null(F.col("version"))), "_fuel": F.lower("fuel"), "_gear": F.lower("transmission"),
            "_color": F.lower("color"), "_engine": P.known(F.col("engine_size")).cast("string"),
            "_power": P.known(F.col("power")).cast("string"), "_year": F.col("year").cast("double"), "_km": F.col("mileage").cast("double"),
            "_ps": P.known(F.col("power")).cast("double"), "_gate": F.greatest(F.lit(25), P.half_up(F.col("power") * F.lit(0.2))).cast("double"),
        }
    )


def block_pairs(queries: DataFrame, candidates: DataFrame, pairs: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """``run(queries, candidates)`` over groups of pairs of blocks of comparable models.

    Both sides come from :func:`scored_keys`; ``key`` spreads the rows of a model over its blocks. Rows get the number of
    their pair of blocks, ``_pair``, and ``_same``, whether the models are equal; ``queries`` also get what ``pairs`` holds
    beside the two models.
    """

    def dealt(rows: DataFrame, model: str, block: str) -> tuple[DataFrame, DataFrame]:
        rows = rows.withColumnRenamed("_model", model)
        count = rows.groupBy("_brand", model).agg(F.count("*").alias(f"_rows{block}"))
        count = count.withColumn(f"_n{block}", F.ceil(F.col(f"_rows{block}") / BLOCK))
        placed = rows.join(count, ["_brand", model]).withColumn(block, F.pmod(F.xxhash64(key), F.col(f"_n{block}")))
        return placed.drop(*count.columns[2:]), count

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    more = [x for x in pairs.columns if x not in ("_brand", "_qmodel", "_cmodel")]
    q, nq = dealt(queries, "_qmodel", "_qb")
    c, nc = dealt(candidates, "_cmodel", "_cb")
    met = pairs.join(nq, ["_brand", "_qmodel"]).join(nc, ["_brand", "_cmodel"])
    met = met.withColumn("_qb", every("_n_qb")).withColumn("_cb", every("_n_cb"))
    met = cut_lineage(
        met.withColumns(
            {"_pair": F.monotonically_increasing_id(), "_same": F.col("_qmodel") == F.col("_cmodel"),
             "_size": F.col("_rows_qb") / F.col("_n_qb") + F.col("_rows_cb") / F.col("_n_cb")}
        )
    )
    groups = int((met.agg(F.sum("_size")).first()[0] or 0) // GROUP) + 1
    met = met.withColumn("_group", F.pmod(F.xxhash64("_pair"), F.lit(groups)))
    q = q.join(met.select("_brand", "_qmodel", "_qb", "_pair", "_group", "_same", *more), ["_brand", "_qmodel", "_qb"])
    c = c.join(met.select("_brand", "_cmodel", "_cb", "_pair", "_group"), ["_brand", "_cmodel", "_cb"])
    q, c = q.toDF(*q.columns), c.toDF(*c.columns)  # both may come from one table
    return q.groupBy("_group").cogroup(c.groupBy("_group")).applyInPandas(run, schema)


def codes(q: pd.Series, c: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal values of both sides; a missing value equals nothing."""
    both, _ = pd.factorize(pd.concat([q, c], ignore_index=True))
    a, b = both[: len(q)].astype(np.int32), both[len(q):].astype(np.int32)
    return a, np.where(b < 0, -2, b).astype(np.int32)


def strips(q: pd.DataFrame, c: pd.DataFrame):
    """The pairs of blocks in strips: rows of ``q``, rows of ``c`` (slices), and their scores as an array.

    Both sides are sorted by ``_pair``.
    """
    equal = [codes(q[n], c[n]) for n in _EQUAL]
    a, b = ({n: side[n].to_numpy(dtype=float, na_value=np.nan) for n in _NUMBERS} for side in (q, c))
    base = np.where(q["_same"], 40, 30).astype(np.int16)
    pairs, first = np.unique(q["_pair"].to_numpy(), return_index=True)
    ends = [*first[1:], len(q)]
    lows, highs = (np.searchsorted(c["_pair"].to_numpy(), pairs, side) for side in ("left", "right"))
    for start, end, low, high in zip(first, ends, lows, highs):
        if low == high:
            continue
        to = slice(low, high)
        rows = max(1, STRIP // (high - low))
        for i in range(start, end, rows):
            at = slice(i, min(end, i + rows))
            score = np.repeat(base[at, None], high - low, axis=1)
            for (x, y), points in zip(equal, (10, 8, 7, 5, 3, 2)):
                score += (x[at, None] == y[to]) * np.int16(points)
            years = np.abs(a["_year"][at, None] - b["_year"][to])
            for limit in (0, 1, 2):
                score += (years <= limit) * np.int16(5)
            km = np.abs(a["_km"][at, None] - b["_km"][to])
            for limit, points in ((5000, 3), (15000, 4), (30000, 3)):
                score += (km <= limit) * np.int16(points)
            score[np.abs(a["_ps"][at, None] - b["_ps"][to]) > a["_gate"][at, None]] = 0
            yield at, to, np.minimum(score, 100)


LEVELS = "sig string, n_exact long, n_same_model long, n_similar long, best_score int"


def level_counts(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    """Per signature of ``q``: items of ``c`` at each level, without the item itself, and the best score."""
    q, c = q.sort_values("_pair"), c.sort_values("_pair")
    n = c["n"].to_numpy(dtype=float)
    mine, theirs = codes(q["sig"], c["sig"])
    found = np.zeros((3, len(q)), np.int64)
    best = np.zeros(len(q), np.int16)
    for at, to, score in strips(q, c):
        # The place of an item among the candidates, if it is one.
        order = np.argsort(theirs[to])
        place = order[np.minimum(np.searchsorted(theirs[to], mine[at], sorter=order), len(order) - 1)]
        me = np.flatnonzero(theirs[to][place] == mine[at])
        place = place[me]
        itself = score[me, place]
        for level, limit in enumerate((P.EXACT_FROM, P.SAME_MODEL_FROM, P.SIMILAR_FROM)):
            found[level, at] = (score >= limit).astype(float) @ n[to]
            found[level, at.start + me] -= itself >= limit
        # An item without copies does not match itself.
        alone = n[to][place] == 1
        score[me[alone], place[alone]] = 0
        best[at] = score.max(axis=1)
    known = pd.Series(best, index=q.index, dtype="Int32").where(best >= P.SIMILAR_FROM)
    return pd.DataFrame(
        {"sig": q["sig"], "n_exact": found[0], "n_same_model": found[1] - found[0], "n_similar": found[2] - found[1], "best_score": known}
    )


def best_offers(k: int, columns: list[str], same_km: int) -> Callable:
    """The candidates of a block that can be among the ``k`` best offers of each query, as q_*, c_* and the score.

    Offers are left out by the rule of :func:`hammertrail.operators.similar.same_vehicle`, and those of the own auction.
    """
    marks = ["hash_id", "reference", "source_url"]

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        q, c = q.sort_values("_pair"), c.sort_values("_pair")
        # An empty mark is unknown.
        other = [codes(q[m].where(q[m] != ""), c[m].where(c[m] != "")) for m in marks]
        other.append(codes(q["auction_id"], c["auction_id"].where(c["hash_id"].notna())))
        ids = codes(q["id"], c["id"])
        brand, model = codes(q["_ubrand"], c["_ubrand"]), codes(q["_umodel"], c["_umodel"])
        qy, cy = (s["_year"].to_numpy(dtype=float, na_value=np.nan) for s in (q, c))
        qk, ck = (np.nan_to_num(s["_km"].to_numpy(dtype=float, na_value=np.nan)) for s in (q, c))
        taken_status = 2 - c["_availability"].to_numpy(dtype=np.int64)
        width, none = len(c) + 2, np.iinfo(np.int64).max
        price = c["starting_price"].rank(method="dense").fillna(len(c) + 1).to_numpy(dtype=np.int64)
        turn = c["id"].rank(method="dense").fillna(0).to_numpy(dtype=np.int64)
        asked = (q["starting_price"].fillna(0) != 0).to_numpy()
        taken, held, scores = [], [], []
        for at, to, score in strips(q, c):
            fits = (score >= P.SIMILAR_FROM) & (score < P.EXACT_FROM) & (ids[0][at, None] >= 0) & (ids[1][to] >= 0)
            for x, y in [*other, ids]:
                fits &= x[at, None] != y[to]
            # With an unknown year the listings may be of one vehicle.
            apart = (qy[at, None] != cy[to]) & ~np.isnan(qy[at, None]) & ~np.isnan(cy[to])
            alike = (brand[0][at, None] == brand[1][to]) & (model[0][at, None] == model[1][to])
            fits &= apart | ~alike | (np.abs(qk[at, None] - ck[to]) > same_km)
            order = np.where(score >= P.SAME_MODEL_FROM, 0, 3) + taken_status[to]
            order = order * width + np.where(asked[at, None], price[to], 0)
            order = (order * 128 + (100 - score)) * width + turn[to]
            order[~fits] = none
            n = order.shape[1]
            few = np.argpartition(order, k - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(order), 1))
            rows, cols = np.repeat(np.arange(len(order)), few.shape[1]), few.ravel()
            good = order[rows, cols] < none
            rows, cols = rows[good], cols[good]
            taken.append(rows + at.start)
            held.append(cols + to.start)
            scores.append(score[rows, cols])
        left, right, score = (np.concatenate(x) if x else np.zeros(0, int) for x in (taken, held, scores))
        sides = [q[columns].take(left).add_prefix("q_"), c[columns].take(right).add_prefix("c_")]
        return pd.concat([s.reset_index(drop=True) for s in sides], axis=1).assign(score=score.astype("int32"))

    return run

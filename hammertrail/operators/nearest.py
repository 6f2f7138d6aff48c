"""The best candidate of every record by blocks: all pairs within the mileage gap at once, as arrays.

The points are those of :func:`hammertrail.operators.identity.identity_score` without marks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from hammertrail.operators.blocks import codes

# Pairs held at once.
STRIP = 1 << 18


def _shared(q: pd.Series, c: pd.Series) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """Places of both sides among the distinct versions, and the words of each."""
    place, texts = pd.factorize(pd.concat([q, c], ignore_index=True))
    return place[: len(q)], place[len(q):], [set(t.split()) for t in texts]


def _version_points(words: list[set], left: np.ndarray, right: np.ndarray, bands: list) -> np.ndarray:
    """Points of every version in ``left`` beside every one in ``right``."""
    names = {t: n for n, t in enumerate(set().union(*[words[v] for v in left], *[words[v] for v in right]))}
    sides = []
    for versions in (left, right):
        has = np.zeros((len(versions), max(len(names), 1)), np.float32)
        for row, v in enumerate(versions):
            has[row, [names[t] for t in words[v]]] = 1
        sides.append(has)
    shared = sides[0] @ sides[1].T
    larger = np.maximum(sides[0].sum(axis=1)[:, None], sides[1].sum(axis=1)[None, :])
    points = np.zeros(shared.shape, np.int16)
    # From the lowest share up: the highest that is reached stays.
    for limit, value, _ in reversed(bands):
        points[(shared > 0) & (shared >= np.float32(limit) * larger)] = value
    return points


def best_of(equal: dict[str, int], spec: list[str], versions: list, km_bands: list, gap: int, proof: int) -> Callable:
    """``run(q, c)`` for :func:`hammertrail.operators.blocks.block_pairs`: id, best candidate and score of the rows of ``q``.

    ``equal`` gives the points of equal columns; without two references a pair needs one of ``spec`` equal, with two
    different ones a mileage within ``proof``. Candidates of unknown mileage count for every record.
    """

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"i_id": [], "c_id": [], "score": []})
        if not len(q) or not len(c):
            return empty
        q, c = q.reset_index(drop=True), c.sort_values(["_pair", "km"]).reset_index(drop=True)
        alike = {n: codes(q[n], c[n]) for n in [*equal, "brand_key"]}
        refs, (qr, cr) = codes(q["reference"], c["reference"]), (s["reference"].notna().to_numpy() for s in (q, c))
        qk, ck = (s["km"].to_numpy(dtype=float, na_value=np.nan) for s in (q, c))
        qv, cv, words = _shared(q["version"], c["version"])
        turn = c["id"].rank(method="first").to_numpy().astype(np.int64) - 1
        by_turn, width = np.argsort(turn), np.int64(len(c))

        # Mileages become places, the unknown one behind all others, so that a pair of blocks and a mileage are one number.
        spots = np.unique(np.concatenate([ck[~np.isnan(ck)], (qk - gap)[~np.isnan(qk)], (qk + gap)[~np.isnan(qk)]]))
        blocks = np.unique(c["_pair"].to_numpy())
        last = len(spots)

        def line(pair, km):
            return np.searchsorted(blocks, pair) * np.int64(last + 1) + np.where(np.isnan(km), last, np.searchsorted(spots, km))

        lines, pair = line(c["_pair"].to_numpy(), ck), q["_pair"].to_numpy()
        unknown = line(pair, np.full(len(q), np.nan))
        start = np.concatenate([np.searchsorted(lines, line(pair, qk - gap), "left"), np.searchsorted(lines, unknown, "left")])
        end = np.concatenate([np.searchsorted(lines, line(pair, qk + gap), "right"), np.searchsorted(lines, unknown, "right")])
        # A record of unknown mileage meets candidates of unknown mileage only, and those once.
        end[: len(q)] = np.where(np.isnan(qk), start[: len(q)], end[: len(q)])
        met = np.isin(pair, blocks)
        rows = np.flatnonzero((end > start) & np.concatenate([met, met]))
        counts, start, rows = (end - start)[rows], start[rows], rows % len(q)
        best = np.full(len(q), -1, np.int64)
        total = np.cumsum(counts)
        base = q["_points"].to_numpy().astype(np.int64)
        done = 0
        while done < len(rows):
            before = total[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(total, before + STRIP, "right")))
            part = slice(done, stop)
            at = np.repeat(rows[part], counts[part])
            first = total[part] - counts[part] - before
            to = np.arange(len(at)) + np.repeat(start[part] - first, counts[part])
            left, li = np.unique(qv[rows[part]], return_inverse=True)
            right, ri = np.unique(cv, return_inverse=True)
            points = _version_points(words, left, right, versions)
            score = base[at] + points[np.repeat(li, counts[part]), ri[to]]
            suits = np.zeros(len(at), bool)
            for name, value in equal.items():
                same = alike[name][0][at] == alike[name][1][to]
                score += same * np.int64(value)
                if name in spec:
                    suits |= same
            off = np.abs(qk[at] - ck[to])
            above = 0
            for limit, value, _ in reversed(km_bands):
                score += (off <= limit) * np.int64(value - above)
                above = value
            both = qr[at] & cr[to]
            fits = np.where(both, (refs[0][at] != refs[1][to]) & (off <= proof), suits)
            fits &= alike["brand_key"][0][at] == alike["brand_key"][1][to]
            order = np.where(fits, score * width - turn[to], -1)
            np.maximum.at(best, rows[part], np.maximum.reduceat(order, first))
            done = stop
        hit = np.flatnonzero(best >= 0)
        score = -(-best[hit] // width)
        return pd.DataFrame(
            {"i_id": q["id"].to_numpy()[hit], "c_id": c["id"].to_numpy()[by_turn[score * width - best[hit]]], "score": score.astype(np.int32)}
        )

    return run

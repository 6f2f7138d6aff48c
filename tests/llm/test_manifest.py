"""Merkle manifest against a plain tree, on odd rows, hot languages and many languages."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hammertrail.llm import merkle
from hammertrail.llm.common import prepare, with_positions

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, index long, tree string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_proofs(rows):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def fold(nodes, at=None, changed=None):
        """Root of a list of digests; with ``at`` also the siblings and the root with one digest changed."""
        siblings = []
        while len(nodes) > 1:
            runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
            if at is not None:
                run = runs[at // 8]
                siblings += run[: at % 8] + run[at % 8 + 1 :]
                changed = sha("".join(run[: at % 8] + [changed] + run[at % 8 + 1 :]))
                at //= 8
            nodes = [sha("".join(r)) for r in runs]
        return nodes[0], siblings, changed

    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        head = "".join(map(field, (doc_id, source, lang, n_chars)))
        touched = text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if touched else text
        trees.setdefault(lang, []).append((doc_id, sha(head + field(text)), sha(head + field(lowered))))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for leaves in trees.values():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subroots = [fold([x[1] for x in trees[k]])[0] for k in langs]
    root = fold(subroots)[0] if langs else None
    out = Counter()
    for place, lang in enumerate(langs):
        for at, (doc_id, leaf, tampered) in enumerate(trees[lang]):
            _, low, changed = fold([x[1] for x in trees[lang]], at, tampered)
            _, high, folded = fold(subroots, place, changed)
            out[doc_id, leaf, subroots[place], root, sha("".join(low + high)), folded, folded == root] += 1
    return out


def odd_rows():
    rows = [(k, f"Text {k} ÄB", "en" if k % 3 else "de", "a", k) for k in range(150)]
    rows += [(None, "No Id", "en", None, None), (None, None, None, None, None), (7, "Text 7 ÄB", "en", "a", 7), (7, "Other", "en", "a", 7)]
    rows += [(7, "Text 7 ÄB", "en", "a", 7)] * 20
    rows += [(200, None, "en", "b", 0), (201, "", "fr", "b", 0), (-5, "Long " * 40_000, "fr", "b", 200_000)]
    return rows


@pytest.mark.parametrize("langs", [0, 12, 70])
def test_proofs(spark, monkeypatch, langs):
    """Small blocks, so that nodes above a block are many; languages of one row and more than one run of them."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK_BITS", 3)
    rows = odd_rows() + [(300 + k, f"One {k}", f"x{k}", "c", 1) for k in range(langs)]
    docs = prepare(spark).createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    made = merkle.proofs(docs)
    assert Counter(map(tuple, made.drop("proof").collect())) == plain_proofs(rows)
    assert made.select(F.sha2(F.lower(F.hex("proof")), 256) == F.col("proof_sha256")).distinct().collect() == [(True,)]


@pytest.mark.parametrize("rows", [[], [(3, "One Row", "en", "a", 1)], [(0, "One Row", "en", "a", 1), (1, "b", "fr", "a", 1)]])
def test_proofs_of_few_rows(spark, rows):
    docs = prepare(spark).createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    assert Counter(map(tuple, merkle.proofs(docs).drop("proof").collect())) == plain_proofs(rows)


def test_positions_of_a_hot_group(spark):
    rows = [("a", k % 50) for k in range(400)] + [(None, 1), (None, None), ("b", 2)]
    df = prepare(spark).createDataFrame(rows, "g string, x long")
    made = with_positions(df, ["g"], ["x"]).collect()
    for g in {r.g for r in made}:
        own = sorted((r.position, r.x) for r in made if r.g == g)
        assert [p for p, _ in own] == list(range(len(own)))
        assert [x for _, x in own] == sorted((x for k, x in rows if k == g), key=lambda x: (x is not None, x or 0))

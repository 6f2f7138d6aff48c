"""Shards of documents: contract on odd and hot tables, and the packing rule against plain Python."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hammertrail.llm import sharding
from hammertrail.llm.common import prepare

DOCS = "doc_id long, text string, shard string, slot long, size int, piece string, bundle string, digest string"


def table_of(spark, rows):
    return prepare(spark).createDataFrame([(*r, "x", 1, 2, "y", "z", "d") for r in rows], DOCS)


def test_place_is_the_dot_product_rule():
    random = np.random.default_rng(3)
    vectors = random.pareto(1.5, (300, 3))
    vectors /= vectors.sum(axis=0)
    free = [[1 / 7] * 3 for _ in range(7)]
    want = [None] * 300
    for item in sorted(range(300), key=lambda k: (-max(vectors[k]), k)):
        scores = [sum(a * b for a, b in zip(f, vectors[item])) for f in free]
        want[item] = max(range(7), key=lambda s: (round(scores[s], 15), -s))
        free[want[item]] = [a - b for a, b in zip(free[want[item]], vectors[item])]
    made = sharding.place(vectors, 7)
    assert (made == np.array(want)).mean() > 0.99
    assert sharding.place(np.zeros((0, 3)), 7).tolist() == []


@pytest.mark.parametrize("hot", [0, 900])
def test_shards(spark, hot):
    random = np.random.default_rng(hot)
    rows = [(k, "wört " * int(random.integers(1, 300)) + f"end {k % 900}") for k in range(2000)]
    rows += [(5000 + k, "copy of one text " * 20) for k in range(hot)] + [(6000, "same row")] * 3
    rows += [(None, "no id"), (None, None), (7000, None), (7001, ""), (7002, "x" * 20_000)]
    made = sharding.shards(table_of(spark, rows)).collect()
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[doc_id].append(text)
    assert Counter(r.doc_id for r in made) == Counter(i for i, _ in rows)
    for r in made:
        assert any(r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) for t in texts[r.doc_id])
    for column in ("size", "tokens"):
        total = Counter()
        for r in made:
            total[r.shard] += r[column]
        assert set(total) == set(range(16)) and max(total.values()) < 1.1 * min(total.values())
    for shard in range(16):
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in made if r.shard == shard)
        assert [s for s, *_ in own] == list(range(len(own)))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)
    homes = defaultdict(set)
    for r in made:
        homes[r.text_crc32, r.size].add(r.shard)
    cut = {k for k, v in homes.items() if len(v) > 1}
    assert cut <= {(zlib.crc32(b"copy of one text " * 20), 341), (0, 1)}
    assert bool(cut - {(0, 1)}) == bool(hot)
    again = sharding.shards(table_of(spark, rows[::-1])).collect()
    assert Counter((r.doc_id, r.size, r.shard) for r in again) == Counter((r.doc_id, r.size, r.shard) for r in made)


def test_shards_of_few_rows(spark):
    assert sharding.shards(table_of(spark, [])).collect() == []
    one = sharding.shards(table_of(spark, [(1, "a text")])).collect()
    assert [(r.doc_id, r.slot) for r in one] == [(1, 0)]
    same = sharding.shards(table_of(spark, [(1, "a text")] * 64)).collect()
    assert Counter(r.shard for r in same) == dict.fromkeys(range(16), 4)

"""Trie of conversation prefixes against plain Python, with hot, long and odd conversations."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hammertrail.llm import trie
from hammertrail.llm.common import prepare

TURNS = "conv_id long, turn int, role string, text string, depth long, p1 string, shard string"


def plain_nodes(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv_id].append((turn is not None, turn or 0, sha, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, own in rebuilt.items():
        path = ()
        members[path].append(c)
        for turn in own:
            kids[path].add((*path, turn))
            path = (*path, turn)
            members[path].append(c)
        ends[path].append(c)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(below[k][0] for k in kids[path])
        below[path] = saved, sum(below[k][1] for k in kids[path]) or 1
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), below[p][1], below[p][0],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def odd_turns():
    random = np.random.default_rng(5)
    rows = []
    for c in range(-12, 90):
        shared = c // 3 if c % 4 else 0
        for t in range(int(random.integers(1, 14))):
            rows.append((c, t, "user" if t % 2 else "assistant", f"turn {t} of {shared if t < 6 else c} ü"))
    rows += [(200, None, "user", "first"), (200, None, None, "first"), (200, 1, "user", None), (200, 1, "user", ""), (200, 1, "user", "")]
    rows += [(None, 1, "user", "of nobody"), (None, None, None, None), (204, 0, "user", "x" * 50_000)]
    rows += [(300, t, "user", f"a long one {t}") for t in range(400)] + [(301, t, "user", f"a long one {t}") for t in range(390)]
    rows += [(c, t, "user", f"all the same {t}") for c in range(400, 480) for t in range(3)]
    return rows


@pytest.mark.parametrize("block_bits", [16, 4])
def test_nodes(spark, monkeypatch, block_bits):
    """Also with blocks of 16 turns, so that conversations spread over shards and carry sums to earlier blocks."""
    monkeypatch.setattr(trie, "BLOCK_BITS", block_bits)
    rows = odd_turns()
    made = trie.nodes(trie.rebuilt(prepare(spark).createDataFrame([(*r, 1, "x", "y") for r in rows], TURNS)))
    assert Counter(map(tuple, made.collect())) == plain_nodes(rows)


def test_colliding_digests_are_found(spark, monkeypatch):
    """With one digest for all prefixes of a depth under the first hash function, the second one is taken."""
    real, seeds = trie.prefixes, []

    def prefixes(turns, seed):
        seeds.append(seed)
        rows = real(turns, seed)
        return rows if seed else rows.withColumns({"p1": rows["depth"], "p2": rows["depth"]})

    monkeypatch.setattr(trie, "prefixes", prefixes)
    rows = [(c, t, "user", f"{c} {t}") for c in range(7) for t in range(3)]
    made = trie.nodes(trie.rebuilt(prepare(spark).createDataFrame([(*r, 1, "x", "y") for r in rows], TURNS)))
    assert Counter(map(tuple, made.collect())) == plain_nodes(rows) and seeds == [0, 1]


def test_slots_are_verified():
    random = np.random.default_rng(1)
    p1, p2 = random.integers(-(2**62), 2**62, (2, 500))
    depth = random.integers(0, 9, 500)
    table = trie.NodeTable(np.r_[depth, depth], np.r_[p1, p1], np.r_[p2, p2])
    assert table.hash.size == 500 and (table.slots(depth, p1, p2) == table.of_rows[:500]).all()
    assert (table.slots(depth + 1, p1, p2) == -1).all() and (table.slots(depth, p2, p1) == -1).all()


def test_no_conversations(spark):
    empty = prepare(spark).createDataFrame([(None, 1, "user", "x", 1, "x", "y")], TURNS)
    assert trie.nodes(trie.rebuilt(empty.limit(0))).collect() == []
    assert trie.nodes(trie.rebuilt(empty)).collect() == []

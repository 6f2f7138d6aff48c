"""A minimal perfect hash over 64-bit keys: levels of bit arrays, one bit per key that is alone in its slot."""

from __future__ import annotations

import numpy as np

from hammertrail.llm.common import mixed

SLOTS_PER_KEY = 2.0


class PerfectHash:
    """Maps n distinct keys to 0..n-1; other keys get any number or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + base)
            base += int(bits.sum())
        self.size = base

    @staticmethod
    def _slots(keys: np.ndarray, level: int, n: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], np.unique(keys.astype(np.uint64))
        while len(rest):
            n = int(SLOTS_PER_KEY * len(rest)) + 1
            slot = cls._slots(rest, len(levels), n)
            alone = np.bincount(slot, minlength=n) == 1
            levels.append(alone)
            rest = rest[~alone[slot]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            slot = self._slots(keys[open_], level, len(bits))
            hit = bits[slot]
            out[open_[hit]] = ranks[slot[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return head + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        count = int(np.frombuffer(blob, "<i8", 1)[0])
        lengths = np.frombuffer(blob, "<i8", count, 8)
        at, levels = 8 * (count + 1), []
        for n in map(int, lengths):
            width = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, width, at), count=n).astype(bool))
            at += width
        return cls(levels)

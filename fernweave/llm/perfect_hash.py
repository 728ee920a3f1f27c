"""Minimal perfect hashes over 64-bit fingerprints: a slot from 0 to n - 1 for each of n keys, without the keys.

Each level is an array of bits, GAMMA for each key that is left. A key whose place in the level no other key shares sets
its bit there; the rest go on to the next level. A key's slot is the number of set bits before its own. A fingerprint
that is no key gets any slot or -1, so a reader compares the stored key.
"""

from __future__ import annotations

import numpy as np

from fernweave.llm.shingles import mix

GAMMA = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    def __init__(self, prints: np.ndarray):
        """prints: distinct uint64 fingerprints."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # words of 64 bits, set bits before each word
        left, before = prints, 0
        while len(left):
            size = np.uint64(max(64, GAMMA * len(left)))
            place = self._places(left, len(self.levels), size)
            words = np.zeros(int(size) // 64 + 1, np.uint64)
            order = np.sort(place)
            lone = np.ones(len(order), bool)
            lone[1:] &= order[1:] != order[:-1]
            lone[:-1] &= order[:-1] != order[1:]
            own = order[lone]
            np.bitwise_or.at(words, (own >> np.uint64(6)).astype(np.int64), np.uint64(1) << (own & np.uint64(63)))
            ranks = before + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((words, ranks))
            before = int(ranks[-1])
            left = left[~self._has(words, place)]

    @staticmethod
    def _places(prints: np.ndarray, level: int, size: np.uint64) -> np.ndarray:
        return mix(prints + _STEP * np.uint64(level + 1)) % size

    @staticmethod
    def _has(words: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def slots(self, prints: np.ndarray) -> np.ndarray:
        """The slot of each fingerprint, -1 where no level has a bit for it."""
        out = np.full(len(prints), -1, np.int64)
        at, left = np.arange(len(prints)), prints
        keys = len(self)
        for level, (words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            count = keys - int(ranks[0])
            place = self._places(left, level, np.uint64(max(64, GAMMA * count)))
            word = (place >> np.uint64(6)).astype(np.int64)
            bit = place & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[at[hit]] = ranks[word[hit]] + np.bitwise_count(below)
            at, left = at[~hit], left[~hit]
        return out

    def __len__(self) -> int:
        return int(self.levels[-1][1][-1]) if self.levels else 0

"""Minimal perfect hashing of digests: every distinct key has a slot of its own in flat arrays without gaps."""

from __future__ import annotations

import numpy as np

from .textkit import mix



def _step(n: int) -> np.uint64:
    return np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))


class SlotTable:
    """Slots 0..size-1 for the distinct pairs of two uint64 digests, each found by hashing and verified against the stored pair.

    Keys that are alone at their place of a level stay there, the others go to the next level, which is smaller; a slot is the
    number of taken places before. Both digests are folded into one key; if two pairs ever fold to the same
    key, which verification shows, all are folded anew with another seed.
    """

    def __init__(self, d1: np.ndarray, d2: np.ndarray, gamma: float = 2.0):
        self.seed = 0
        while True:
            key = self._fold(d1, d2)
            distinct, first = np.unique(key, return_index=True)
            self._build(distinct, gamma)
            self.size = len(distinct)
            self.d1, self.d2 = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64)
            at = self._find(distinct)
            self.d1[at], self.d2[at] = d1[first], d2[first]
            self.slots = self._find(key)
            if np.array_equal(self.d1[self.slots], d1) and np.array_equal(self.d2[self.slots], d2):
                return
            self.seed += 1

    def _fold(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        return mix(d1 + _step(2 * self.seed + 1)) ^ mix(d2 + _step(self.seed))

    def _build(self, keys: np.ndarray, gamma: float) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        before = 0
        while len(keys):
            width = max(2, int(gamma * len(keys)))
            place = self._place(keys, len(self.levels), width)
            alone = np.bincount(place, minlength=width) == 1
            self.levels.append((alone, np.cumsum(alone) - alone + before))
            before += int(alone.sum())
            keys = keys[~alone[place]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, width: int) -> np.ndarray:
        return (mix(keys + _step(level + 1)) % np.uint64(width)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(keys[left], level, len(alone))
            here = alone[place]
            slot[left[here]] = rank[place[here]]
            left = left[~here]
        return slot

    def find(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 for pairs that the table doesn't hold."""
        slot = self._find(self._fold(d1, d2))
        held = slot >= 0
        held[held] = (self.d1[slot[held]] == d1[held]) & (self.d2[slot[held]] == d2[held])
        return np.where(held, slot, -1)

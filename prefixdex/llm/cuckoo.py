"""A cuckoo filter over 64-bit hashes, as one small array per shard."""

from __future__ import annotations

import numpy as np

from prefixdex.llm.words import mix

SLOTS = 4
_KICKS = 500


class CuckooFilter:
    """Buckets of four 16-bit marks; a key lies in one of two buckets, each
    found from the other and the mark, so keys can be deleted again. Only keys
    that were inserted may be deleted. A full filter is built anew, twice as
    large, from ``keys`` of the caller (``insert`` returns False)."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is not None:
            self.table = table
            return
        buckets = 1
        while buckets * SLOTS * 0.85 < capacity:
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = mix(np.asarray(keys).astype(np.uint64))
        mask = np.uint64(len(self.table) - 1)
        mark = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint64)
        one = keys & mask
        return mark.astype(np.uint16), one, one ^ (mix(mark) & mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        mark = mark[:, None]
        return (self.table[one] == mark).any(1) | (self.table[two] == mark).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        mask = len(self.table) - 1
        turn = 0
        for mark, one, two in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            at = one if 0 in self.table[one] else two
            for _ in range(_KICKS):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    break
                turn = (turn + 1) % SLOTS
                mark, self.table[at, turn] = int(self.table[at, turn]), mark
                at ^= int(mix(np.array([mark], np.uint64))[0]) & mask
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for mark, one, two in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for at in (one, two):
                held = np.flatnonzero(self.table[at] == mark)
                if len(held):
                    self.table[at, held[0]] = 0
                    break


def build(keys: np.ndarray, capacity: int = 0) -> CuckooFilter:
    """A filter that holds all ``keys``."""
    capacity = max(capacity, len(keys), 4)
    while True:
        made = CuckooFilter(capacity)
        if made.insert(keys):
            return made
        capacity *= 2

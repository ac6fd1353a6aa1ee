"""A hash table in numpy from short strings to token ids.

A string of up to 23 bytes is a key of three 64-bit integers: its bytes, zeros, and their number in the
last byte. So equal keys are equal strings, and thousands are looked up, compared and added at a time
without an object for any of them.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the longest string that has a key.
SHORT = 23
#: The first bytes of a little-endian integer, by how many.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def keys_at(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The keys of stretches of `raw`, which has SHORT + 1 bytes more than these. Of one longer than SHORT: no key."""
    over = np.ndarray(max(len(raw) - 7, 0), "<u8", raw, strides=(1,))
    out = np.empty((len(begin), 3), "<u8")
    for k in range(3):
        out[:, k] = over[np.minimum(begin + 8 * k, len(over) - 1)] & FIRST[np.clip(size - 8 * k, 0, 8)]
    out[:, 2] = out[:, 2] & FIRST[7] | size.astype(np.uint64) << np.uint64(56)
    return out


class Units:
    """The first KNOWN strings that are met, which the common ones are among, and their ids in `pool`.

    Others' ids are put behind these until again() is called.
    """

    BITS, KNOWN, START = 21, 1 << 20, 1 << 20

    def __init__(self, dtype: np.dtype):
        self.slots = np.zeros(1 << self.BITS, np.int32)  # the number of an entry, from 1 on
        self.keys = np.empty((self.KNOWN + 1, 3), "<u8")  # memory is taken as it is filled
        self.first, self.size = np.empty(self.KNOWN + 1, np.int32), np.empty(self.KNOWN + 1, np.int32)
        self.keys[0], self.first[0], self.size[0] = 0, -1, 0
        self.pool = np.empty(self.START, dtype)
        self.n = self.used = self.top = 0

    def slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys[:, 0] * MIX[0] ^ keys[:, 1] * MIX[1] ^ keys[:, 2] * MIX[2]
        return ((x ^ x >> np.uint64(31)) * MIX[0] >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key's ids begin in `pool` (-1: unknown) and how many they are."""
        slot = self.slot(keys)
        out = self.slots[slot].astype(np.int64)
        left, met = np.arange(len(keys)), out
        while left.size:
            own = self.keys.take(met, 0)
            left = left[(met > 0) & ((own[:, 0] != keys[left, 0]) | (own[:, 1] != keys[left, 1]) | (own[:, 2] != keys[left, 2]))]
            slot[left] = (slot[left] + 1) & ((1 << self.BITS) - 1)
            met = out[left] = self.slots[slot[left]]
        return self.first[out].astype(np.int64), self.size[out].astype(np.int64)

    def again(self) -> None:
        """What has been put behind the known ones is given up."""
        self.top = self.used
        if len(self.pool) > max(4 * self.used, self.START):
            self.pool = self.pool[: max(2 * self.used, self.START)].copy()

    def put(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where stretches of these ids, of `size` each, begin in `pool`, until again() is called."""
        first, self.top = self.top + np.cumsum(size) - size, self.top + len(ids)
        if self.top > len(self.pool):
            pool = np.empty(max(self.top, 2 * len(self.pool)), self.pool.dtype)
            pool[: self.top - len(ids)] = self.pool[: self.top - len(ids)]
            self.pool = pool
        self.pool[self.top - len(ids) : self.top] = ids
        return first

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """put() for different keys that aren't known, and are from here on if there is room."""
        first = self.put(ids, size)
        if k := min(len(keys), self.KNOWN - self.n):
            own = np.arange(self.n + 1, self.n + 1 + k, dtype=np.int32)
            self.keys[own], self.first[own], self.size[own] = keys[:k], first[:k], size[:k]
            slot = self.slot(keys[:k])
            while own.size:
                free = self.slots[slot] == 0
                self.slots[slot[free]] = own[free]  # of those that want one slot, one gets it
                stay = self.slots[slot] != own
                own, slot = own[stay], (slot[stay] + 1) & ((1 << self.BITS) - 1)
            self.n, self.used = self.n + k, int(first[k - 1] + size[k - 1])
        return first

"""Minimal perfect hashes of term lists, with the terms stored by slot.

Keys are placed in levels of bits: a key takes its place in a level if no other key has the same, and else goes on to the
next, smaller level. A key's slot is the number of taken places before its own. Whether a term is a key at all is decided by
comparing it with the key stored in its slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute

from .common import mix

LEVELS = 24
"""Levels; the few keys that are left after them, or whose 64-bit hashes are equal, are looked up by themselves."""


def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes, 60 + level) % np.uint64(size)).astype(np.int64)


class Shard:
    """The keys of a shard in slot order and the levels that give the slots."""

    def __init__(self, sizes: list[int], bits: bytes, keys: pa.Array) -> None:
        self.sizes, self.keys = sizes, keys
        self.words = np.frombuffer(bits, np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        placed = int(ones.sum())
        self.rest = {k: placed + i for i, k in enumerate(keys.slice(placed).to_pylist())}

    @staticmethod
    def build(keys: pa.Array, hashes: np.ndarray) -> tuple[list[int], bytes, pa.Array]:
        """(sizes, bits, keys in slot order) of different binary keys."""
        left, sizes, levels, order = np.arange(len(hashes)), [], [], []
        while len(left) and len(sizes) < LEVELS:
            size = 64 * max(1, -(-2 * len(left) // 64))
            at = _places(hashes[left], len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            taken = np.zeros(size, np.uint8)
            taken[at[alone]] = 1
            order.append(left[alone][np.argsort(at[alone])])
            levels.append(np.packbits(taken, bitorder="little"))
            sizes.append(size)
            left = left[~alone]
        bits = np.concatenate(levels).tobytes() if levels else b""
        return sizes, bits, keys.take(pa.array(np.concatenate([*order, left]) if len(hashes) else left, pa.int64()))

    def slots(self, terms: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 for those that are no keys."""
        found = np.full(len(hashes), -1, np.int64)
        open_, base = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            at = base + _places(hashes[open_], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_, base = open_[~hit], base + size
        known = found >= 0
        same = self.keys.take(pa.array(np.where(known, found, 0))) if len(self.keys) else terms
        found[~(known & pa.compute.equal(same, terms).to_numpy(zero_copy_only=False))] = -1
        if self.rest:
            for i in np.flatnonzero(found < 0).tolist():
                found[i] = self.rest.get(terms[i].as_py(), -1)
        return found

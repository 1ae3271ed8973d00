"""Minimal perfect hashing of whole-number keys, one function for each shard of them.

After Limasset et al., "Fast and Scalable Minimal Perfect Hashing for Massive Key
Sets" (2017): on each level the keys that fall alone into a slot get it, the rest go
on to the next. The index of a key is the number of taken slots before its own. Other
keys get some index too, so the keys themselves are stored by index and compared.
"""

from __future__ import annotations

import numpy as np

ROOM = 1.5  # slots for each key of a level
LEVELS = 200


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Slots of keys on a level: multiplied, folded and multiplied again."""
    mixed = keys.astype("u8") + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(factor)
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(size)).astype("int64")


class PerfectHash:
    """``sizes`` of the levels and ``bits`` of their taken slots."""

    def __init__(self, sizes: list, bits: bytes):
        self.sizes, self.bits = sizes, bits
        taken = np.unpackbits(np.frombuffer(bits, "u1"), bitorder="little").astype(bool)
        self.before = np.cumsum(taken) - taken
        self.taken = taken

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys."""
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = 8 * int(np.ceil(ROOM * len(left) / 8))
            slots = _slots(left, len(sizes), size)
            alone = np.bincount(slots, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[slots]]
        return cls(sizes, np.packbits(np.concatenate([*levels, np.empty(0, bool)]), bitorder="little").tobytes())

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; 0 where none of the levels has one."""
        out, left, first = np.zeros(len(keys), "int64"), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            slots = _slots(keys[left], level, size) + first
            found = self.taken[slots]
            out[left[found]] = self.before[slots[found]]
            left, first = left[~found], first + size
            if not len(left):
                break
        return out

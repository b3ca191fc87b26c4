"""A minimal perfect hash over 64-bit keys, built and probed with whole numpy arrays.

Keys go through levels. A level has about as many bits as keys left; a key that no other key meets sets its bit and is
placed, the others go on to the next level. The number of set bits before a key's bit is its slot, so n keys fill the
slots 0 to n-1. A key outside the set gets any slot or none, so callers keep a fingerprint in each slot.
"""

from __future__ import annotations

import numpy as np

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
LEVELS = 40


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well mixed 64-bit hash of each key for a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + _MIX[0] * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct keys; `sizes` and `bits` are all that has to be stored."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits, self.ranks, before = sizes, bits, [], 0
        for b in bits:
            self.ranks.append(before + np.concatenate(([0], np.cumsum(b)[:-1])).astype(np.int64) if len(b) else b)
            before += int(b.sum())
        self.n = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, bits = np.unique(keys.astype(np.uint64)), [], []
        if len(left) != len(keys):
            raise ValueError("keys of a perfect hash must be distinct")
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(2, len(left))
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys could not be placed")
        return cls(sizes, bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has a bit for it."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks, strict=True)):
            if not len(open_):
                break
            at = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out

    def packed(self) -> bytes:
        """Number of levels, their sizes and their bits."""
        head = np.array([len(self.sizes), *self.sizes], "<u4").tobytes()
        return head + b"".join(np.packbits(b).tobytes() for b in self.bits)

    @classmethod
    def unpacked(cls, data: bytes, at: int) -> tuple[PerfectHash, int]:
        """The hash stored at a position, and where it ends."""
        levels = int(np.frombuffer(data, "<u4", 1, at)[0])
        sizes, at, bits = np.frombuffer(data, "<u4", levels, at + 4).tolist(), at + 4 + 4 * levels, []
        for size in sizes:
            width = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(sizes, bits), at

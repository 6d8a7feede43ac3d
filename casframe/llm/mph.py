"""A minimal perfect hash over byte keys, in numpy.

Levels of bit arrays: on each level the keys left over are hashed into slots;
those that are alone in a slot take it, the others go down a level.  A key's
number is the rank of its bit among all bits, so n keys get 0 to n - 1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

from casframe.llm.common import stream64

#: Slots per key on each level; keys left after MAX_LEVELS would mean equal hashes.
LOAD = 2
MAX_LEVELS = 64


def hashes(keys: Sequence[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(k, seed) for k in keys), np.uint64, len(keys))


class PerfectHash:
    """Numbers for distinct keys; a key that was not given gets -1 or some key's number."""

    def __init__(self, seed: int, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray) -> None:
        self.seed, self.sizes, self.bits, self.ranks = seed, sizes, bits, ranks
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: Sequence[bytes]) -> PerfectHash:
        """Raises ValueError where a key is given twice."""
        for seed in range(4):
            h = hashes(keys, seed)
            if len(np.unique(h)) == len(h):
                break
        else:
            raise ValueError("keys are not distinct")
        sizes, parts, left = [], [], h
        while len(left):
            size = max(LOAD * len(left), 2)
            at = (stream64(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[at]]
            if len(sizes) > MAX_LEVELS:
                raise ValueError("too many levels")
        bits = np.concatenate(parts) if parts else np.zeros(0, bool)
        return cls(seed, np.array(sizes, np.int64), bits, cls.rank(bits))

    @staticmethod
    def rank(bits: np.ndarray) -> np.ndarray:
        return (np.cumsum(bits) - bits).astype(np.int32)

    def numbers(self, keys: Sequence[bytes]) -> np.ndarray:
        return self.of_hashes(hashes(keys, self.seed))

    def of_hashes(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        rest = np.arange(len(h))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = (stream64(h[rest], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.bits[at]
            out[rest[hit]] = self.ranks[at[hit]]
            rest = rest[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([self.seed, len(self.sizes), *self.sizes], np.int64).tobytes()
        return head + np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        seed, levels = np.frombuffer(data, np.int64, 2)
        sizes = np.frombuffer(data, np.int64, int(levels), 16)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=16 + 8 * int(levels)), count=int(sizes.sum())).astype(bool)
        return cls(int(seed), sizes, bits, cls.rank(bits))

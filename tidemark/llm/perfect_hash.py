"""Minimal perfect hash of pairs of 64-bit numbers, built and asked in numpy.

Level by level the remaining keys are thrown into a bit array twice their
number; keys that are alone in their place are settled, the others go on. A
key's number is the count of set bits before its own. About three bits a key.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.flat import U64, mix

SPREAD = 2


def pair_hash(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of pairs; seeds behave as independent, also for pairs that collide under one of them."""
    salt = mix(np.array([seed + 1], U64) * U64(0x9E3779B97F4A7C15))[0]
    return mix(mix(a ^ salt) + b * U64(0xD1342543DE82EF95) + salt)


class PerfectHash:
    """Numbers 0..n-1 of ``n`` different keys; other keys get any number or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(bits).astype(np.int64) for bits in levels]
        ones = np.cumsum([0, *(c.sum() for c in counts)])
        self.before = [first + np.cumsum(c) - c for first, c in zip(ones, counts)]
        self.n = int(ones[-1])

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(a):
            words = -(-SPREAD * len(a) // 64)
            at = (pair_hash(a, b, len(levels)) % U64(64 * words)).astype(np.int64)
            alone = np.bincount(at, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = ~alone[at]
            a, b = a[rest], b[rest]
            if len(levels) > 400:
                raise ValueError("keys are not different")
        return cls(levels)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for seed, (bits, before) in enumerate(zip(self.levels, self.before)):
            if not len(left):
                break
            at = pair_hash(a[left], b[left], seed) % U64(64 * len(bits))
            word, bit = (at >> U64(6)).astype(np.int64), at & U64(63)
            held = bits[word]
            hit = (held >> bit) & U64(1) == 1
            below = np.bitwise_count(held & ((U64(1) << bit) - U64(1)))
            out[left[hit]] = before[word[hit]] + below[hit]
            left = left[~hit]
        return out

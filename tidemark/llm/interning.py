"""Open-addressed table of byte strings in numpy, and xxhash64 of many strings at once."""

from __future__ import annotations

import numpy as np
import xxhash

from tidemark.llm.flat import U64

# The primes of the public xxhash64 definition.
P1, P2, P3, P4, P5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_LONG = 32  # longer strings are hashed one by one


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def xxhash64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of stretches of ``data``; those below 32 bytes in one go for each length."""
    out = np.empty(len(starts), U64)
    order = np.argsort(lengths, kind="stable")
    sizes, cut = np.unique(lengths[order], return_index=True)
    for size, lo, hi in zip(sizes.tolist(), cut.tolist(), np.append(cut[1:], len(order)).tolist()):
        at = order[lo:hi]
        if size >= _LONG:
            out[at] = [xxhash.xxh64_intdigest(data[s : s + size]) for s in starts[at].tolist()]
            continue
        raw = data[starts[at][:, None] + np.arange(size)]
        h = np.full(len(at), P5 + U64(size))
        k = 0
        while k + 8 <= size:
            lane = np.ascontiguousarray(raw[:, k : k + 8]).view("<u8")[:, 0]
            h = _turn(h ^ (_turn(lane * P2, 31) * P1), 27) * P1 + P4
            k += 8
        if k + 4 <= size:
            lane = np.ascontiguousarray(raw[:, k : k + 4]).view("<u4")[:, 0].astype(U64)
            h = _turn(h ^ (lane * P1), 23) * P2 + P3
            k += 4
        for j in range(k, size):
            h = _turn(h ^ (raw[:, j].astype(U64) * P5), 11) * P1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        out[at] = h ^ (h >> U64(32))
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``lengths`` at ``a`` and at ``b`` hold the same bytes."""
    if not len(a):
        return np.zeros(0, bool)
    ends = np.cumsum(lengths)
    inner = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    differ = np.concatenate(([0], np.cumsum(data[np.repeat(a, lengths) + inner] != data[np.repeat(b, lengths) + inner])))
    return differ[ends] == differ[ends - lengths]


class Interned:
    """Different byte strings of a batch in an open-addressed table with linear probing.

    ``slot``: table slot of each occurrence. ``owner``: an occurrence for each
    used slot, -1 for free ones. ``count``: occurrences of each slot.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray | None = None):
        n = len(starts)
        self.keys = xxhash64(data, starts, lengths) if hashes is None else hashes
        size = 1 << max(4, (2 * n - 1).bit_length())
        mask = U64(size - 1)
        self.owner = np.full(size, -1, np.int64)
        self.slot = (self.keys & mask).astype(np.int64)
        left = np.arange(n)
        while len(left):
            at = self.slot[left]
            free = self.owner[at] < 0
            self.owner[at[free]] = left[free]  # of several that want a free slot one gets it
            own = self.owner[at]
            hit = own == left
            check = np.flatnonzero(~hit & (self.keys[own] == self.keys[left]) & (lengths[own] == lengths[left]))
            hit[check] = same_bytes(data, starts[own[check]], starts[left[check]], lengths[left[check]])
            left = left[~hit]
            self.slot[left] = (self.slot[left] + 1) & (size - 1)
        self.count = np.bincount(self.slot, minlength=size)
        self.used = np.flatnonzero(self.owner >= 0)

"""Whole text columns as flat arrays, so that tasks work on all words of many texts at once.

A record batch is cut into blocks of whole rows of about ``size`` bytes; one
long text makes a block of its own. Words are the runs of bytes other than
space and \\t..\\r, which is the same on bytes and on code points of UTF-8.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOW = 1 << 20  # positions with a random factor of their own; longer runs combine two factors


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _factors(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 40)) * U64(0x9E3779B97F4A7C15)) | U64(1)


_cache: dict[int, np.ndarray] = {}


def factors(n: int, seed: int) -> np.ndarray:
    """At least ``n`` odd random factors of this seed."""
    have = _cache.get(seed)
    if have is None or len(have) < n:
        have = _cache[seed] = _factors(max(n, 1024), seed)
    return have


def raw(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of each block."""
    at, data = raw(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of True; a run never crosses a row's end."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets[1:], starts, "right")


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run; ``values`` (unsigned 64-bit) must be 0 outside runs and above 0 inside."""
    if not len(starts):
        return np.zeros(0, U64)
    s0, n = starts[0], len(values)
    longest = int((ends - starts).max())
    pos = np.arange(s0, n) - np.repeat(starts, np.diff(np.append(starts, n)))
    np.minimum(pos, longest - 1, out=pos)
    if longest <= _LOW:
        terms = values[s0:] * factors(longest, seed)[pos]
    else:
        terms = values[s0:] * factors(_LOW, seed)[pos & (_LOW - 1)] * factors((longest >> 20) + 1, seed + 100)[pos >> 20]
    return mix(np.add.reduceat(terms, starts - s0) ^ ((ends - starts).astype(U64) << U64(40)))


BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """At least ``n`` powers of an odd base modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), base, U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have


_BYTE = {seed: mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15 + 2 * seed)) | U64(1) for seed in range(4)}


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


class Words:
    """Words of a block: byte spans, row of each, and one or more 64-bit hashes of their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: tuple[int, ...] = (1,)):
        inside = ~SPACE[data]
        self.starts, self.ends, self.rows = runs(inside, offsets)
        self.n_rows = len(offsets) - 1
        self.hashes, self.sums = [], {}
        for seed in seeds:
            values = _BYTE[seed][data]
            values[~inside] = 0
            self.hashes.append(run_hashes(values, self.starts, self.ends, seed))
        self.counts = np.bincount(self.rows, minlength=self.n_rows)
        self.firsts = np.concatenate(([0], np.cumsum(self.counts)))

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``n`` consecutive words of one row."""
        m = len(self) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.rows[:m] == self.rows[n - 1 :])
        upto = self.rolling(seed)
        return at, mix((upto[at + n] - upto[at]) * powers(len(self), BACK)[at] + U64(n))

    def rolling(self, seed: int) -> np.ndarray:
        """Running sums of the words' hashes times rising powers of ``BASE``, modulo 2^64: two of them give the hash of any window."""
        if seed not in self.sums:
            terms = self.hashes[seed] * powers(len(self), BASE)[: len(self)]
            self.sums[seed] = np.concatenate((np.zeros(1, U64), np.cumsum(terms, dtype=U64)))
        return self.sums[seed]


def row_sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of True in each row."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def per_row(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that differ between rows."""
    return mix(keys + rows.astype(U64) * U64(0x9E3779B97F4A7C15))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys found more than once."""
    order = np.argsort(keys)
    equal = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


def covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the positions in 0..n-1 that a window of ``length`` starting at one of ``at`` covers."""
    step = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + length, n), minlength=n + 1)
    return np.cumsum(step[:n]) > 0


#: Rows and bytes of a record batch: a task holds a few of them, in the JVM and in Python.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def small_batches(spark: SparkSession) -> None:
    """Keep the record batches of this session's Arrow operators small."""
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)


try:
    _trim = ctypes.CDLL(None).malloc_trim  # glibc only
except (AttributeError, OSError):
    _trim = None


def give_back() -> None:
    """Return freed buffers to the system: workers live on, and the next stage needs the memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def over_texts(docs: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply ``work`` to record batches of (doc_id, text); nothing is shuffled. Sets small batches for the session."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what the stages before left
        for batch in batches:
            if batch.num_rows:
                yield work(batch)
                give_back()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

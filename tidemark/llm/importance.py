"""Importance resampling toward a target distribution over hashed n-grams (operator 13).

Features are the runs of ``least`` to ``most`` consecutive words of a text,
joined by a space; a feature's bucket is its crc32 modulo ``buckets``. Bucket
counts of the corpus and of the target texts give each bucket a gain, the log
ratio of its smoothed shares. A document's weight is the mean gain of its
features; with a Gumbel number of its own added, the highest scores are a draw
without replacement.

A task puts the features of a block of texts into an open-addressed table
(``interning``), so that a feature's bytes are hashed to a bucket once per
block; its slots hold bucket and count, and the slot of each occurrence
gathers the gains. Bucket counts leave a task as at most ``buckets`` numbers;
the gains, ``buckets`` numbers too, are broadcast. Ranks come from a range sort.

Null and empty texts have no features, weight 0 and a score, but are never
drawn. The number drawn from a null ``doc_id`` is that of an empty id.
Repeated rows get a row each; rows of equal score and id are ranked by
features and weight. An empty table gives no rows, empty targets smoothed shares.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.flat import blocks, lower_ascii, over_texts, runs, small_batches
from tidemark.llm.interning import Interned
from tidemark.llm.ordering import places
from tidemark.llm.pieces import gather
from tidemark.session import settle

SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


@dataclass(frozen=True)
class Draw:
    """``percent`` of the documents with ``min_words`` words or more are drawn; gains and scores are in 1/``scale``."""

    least: int = 1
    most: int = 1
    buckets: int = 10_000
    seed: int = 2024
    percent: int = 10
    min_words: int = 20
    scale: int = 1000


IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Features:
    """Features of a block of texts: bucket and row of each occurrence."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, draw: Draw):
        n = len(offsets) - 1
        data = lower_ascii(data)
        starts, ends, rows = runs(IN_WORD[data], offsets)
        self.words = np.bincount(rows, minlength=n)
        # words one after the other with a space behind each: every n-gram is a stretch of this
        text, upto = gather(np.append(data, np.uint8(32)), starts, ends - starts + 1)
        text = np.array(text)
        text[upto - 1] = 32
        begin = upto - (ends - starts + 1)
        self.rows, self.buckets, self.slots = [], [], []
        for k in range(draw.least, draw.most + 1):
            m = max(0, len(starts) - k + 1)
            at = np.flatnonzero(rows[:m] == rows[k - 1 : k - 1 + m]) if m else np.zeros(0, np.int64)
            first, size = begin[at], upto[at + k - 1] - 1 - begin[at]
            table = Interned(text, first, size)
            bucket = np.zeros(len(table.owner), np.int64)
            own, raw = table.owner[table.used], text.tobytes()
            bucket[table.used] = [zlib.crc32(raw[a : a + s]) % draw.buckets for a, s in zip(first[own].tolist(), size[own].tolist())]
            self.rows.append(rows[at])
            self.slots.append(table.slot)
            self.buckets.append((bucket, table.count))
        self.n = n

    def counts(self, buckets: int) -> np.ndarray:
        """Occurrences by bucket, from the slots' counts."""
        return sum((np.bincount(b, weights=c, minlength=buckets).astype(np.int64) for b, c in self.buckets), np.zeros(buckets, np.int64))

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and sum of gains of each row."""
        size, total = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for rows, slots, (bucket, _) in zip(self.rows, self.slots, self.buckets):
            size += np.bincount(rows, minlength=self.n)
            np.add.at(total, rows, gains[bucket[slots]])
        return size, total


def bucket_counts(texts: DataFrame, draw: Draw) -> np.ndarray:
    """Occurrences of each bucket in all of ``text``; a task gives a row for each bucket it has."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column("text")):
                total += Features(data, offsets, draw).counts(draw.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(draw.buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray, draw: Draw) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket, rounded down."""
    s_all, t_all = float(corpus.sum() + draw.buckets), float(target.sum() + draw.buckets)
    ratios = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(draw.scale * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in ratios], np.int64)


def gumbel(doc_id: int | None, draw: Draw) -> int:
    """The number added to a document's weight, from its id and the seed."""
    h = int(hashlib.sha256(f"{draw.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-draw.scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: np.ndarray, draw: Draw) -> DataFrame:
    """Features, weight and score of each row of ``docs`` (``doc_id``, ``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, size, total = [], [], []
        for _, _, data, offsets in blocks(batch.column("text")):
            found = Features(data, offsets, draw)
            words.append(found.words)
            for to, x in zip((size, total), found.sums(shared.value)):
                to.append(x)
        size, total = np.concatenate(size), np.concatenate(total)
        weight = np.where(size > 0, total // np.maximum(size, 1), 0)
        ids = batch.column("doc_id").cast(pa.int64())
        own = np.array([gumbel(d, draw) for d in ids.to_pylist()], np.int64)
        numbers = {"n_words": np.concatenate(words), "n_features": size, "weight": weight, "score": weight + own}
        return pa.RecordBatch.from_pydict({"doc_id": ids} | {k: pa.array(v, pa.int64()) for k, v in numbers.items()})

    return over_texts(docs, SCORED, work)


def resample(docs: DataFrame, target: DataFrame, draw: Draw | None = None) -> DataFrame:
    """Per row of ``docs`` its features, weight and score, and the rank among the drawn (null: not drawn); ``target`` has ``text``."""
    draw = draw or Draw()
    gains = gains_of(bucket_counts(docs, draw), bucket_counts(target, draw), draw)
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    scored = scores(docs, gains, draw).withColumn("fit", (F.col("n_words") >= draw.min_words).cast("int"))
    placed = places(settle(scored), order, "at")
    fit = placed.agg(F.coalesce(F.sum("fit"), F.lit(0))).first()[0]
    rank = F.when(F.col("at") < draw.percent * fit // 100, F.col("at") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))

"""Near-duplicate documents by SetSketch registers (operator 5).

The sketch of a set of shingles holds 256 registers; each is the smallest of
exponentially distributed values of the elements, on an exponential scale and
truncated to a byte. An element's values come in ascending order, each to
another register, so an element stops as soon as it can't lower any register.
Sketches of unions are the register-wise extremes, and equal registers are as
frequent as elements are shared.

1. Equal sets are one node, however many copies a document has.
2. Bands of registers are hashed; nodes with an equal band are candidates. In
   a bucket only the pairs with its smallest and its largest member are formed.
3. The similarity of a candidate pair is estimated by maximum likelihood from
   the registers of both and the set sizes. Pairs far below the threshold go.
4. Links are confirmed on the full sets: first the best pair of each node,
   then pairs that still join different components.
5. Members of a bucket left in different components have not been compared
   with each other. An exact prefix filter on their full sets forms the pairs
   that can be similar enough, and these go through 3 and 4.

With 42 bands of 6 registers, a pair at the threshold 0.8 shares no band with
probability 3e-6, and the estimate is off by the margin 0.15 (six standard
errors) less often. Null and empty texts have the empty set and are linked
with nothing. Rows with null ``doc_id`` take no part and are kept. Repeated
rows get a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.flat import U64, Words, blocks, factors, lower_ascii, mix, over_texts, per_row
from tidemark.session import settle

REGISTERS = 256
BASE = 1.1
SHIFT = 25  # register value of a minimum of 1
BROADCAST_IDS = 1_000_000  # 8 bytes each, counted before they are broadcast; more are joined by a shuffle
SKETCHES = "doc_id bigint, n bigint, hi bigint, lo bigint, sketch binary"


@dataclass(frozen=True)
class Near:
    """Words to a shingle, least similarity in percent, rows to a band, and how far an estimate may lie below."""

    words: int = 4
    percent: int = 80
    band: int = 6
    margin: float = 0.15


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of the distinct shingles, by row then hash; a short text is one shingle."""
    found = Words(lower_ascii(data), offsets)
    at, h = found.windows(words)
    rows = found.rows[at]
    for k in range(1, words):
        short = np.flatnonzero(found.counts == k)
        if len(short):
            total = np.zeros(len(short), U64)
            for j in range(k):
                total += found.hashes[0][found.firsts[short] + j] * factors(words + k, 70)[j]
            rows, h = np.concatenate((rows, short)), np.concatenate((h, mix(total + U64(k))))
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    return rows[new], h[new]


def _salt(k: int) -> np.uint64:
    return U64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def sketches(rows: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """Registers of each row's set."""
    out = np.zeros((n_rows, REGISTERS), np.uint8)
    flat = out.reshape(-1)
    spread = mix(h ^ U64(0xA0761D6478BD642F))
    start, step = (spread & U64(255)).astype(np.int64), (spread >> U64(8) & U64(255) | U64(1)).astype(np.int64)
    x = np.zeros(len(h))
    scale = 1 / np.log(BASE)
    for k in range(REGISTERS):
        u = ((mix(h + _salt(k + 1)) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = x - np.log(u) * (1 / (REGISTERS - k))
        level = np.clip(np.floor(SHIFT - np.log(x) * scale), 0, 255).astype(np.uint8)
        np.maximum.at(flat, rows * REGISTERS + (start + k * step & 255), level)
        low = out.min(axis=1)
        on = level > low[rows]
        if not on.any():
            break
        if not on.all():
            rows, h, x, start, step = rows[on], h[on], x[on], start[on], step[on]
    return out


def sketch_documents(docs: DataFrame, words: int) -> DataFrame:
    """Set size, 128-bit fingerprint of the set and sketch of each row; the empty set has no sketch."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, hi, lo, sketch = [], [], [], []
        for a, b, data, offsets in blocks(batch.column("text")):
            rows, h = shingle_sets(data, offsets, words)
            count = np.bincount(rows, minlength=b - a)
            n.append(count)
            for out, salt in ((hi, 11), (lo, 23)):
                total = np.zeros(b - a, U64)
                np.add.at(total, rows, mix(h + _salt(salt)))
                out.append(mix(total ^ count.astype(U64)).view(np.int64))
            sketch += [s.tobytes() if c else None for s, c in zip(sketches(rows, h, b - a), count)]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").cast(pa.int64()), "n": pa.array(np.concatenate(n), pa.int64()),
                "hi": pa.array(np.concatenate(hi), pa.int64()), "lo": pa.array(np.concatenate(lo), pa.int64()), "sketch": pa.array(sketch, pa.binary()),
            }
        )

    return over_texts(docs, SKETCHES, work)


def _bands(nodes: DataFrame, band: int) -> DataFrame:
    """(key, node) of every band of every node."""
    count = REGISTERS // band

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            registers = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            parts = registers[:, : count * band].reshape(len(registers), count, band).astype(U64) + U64(1)
            keys = mix((parts * factors(band, 80)[:band]).sum(axis=2, dtype=U64) + factors(count, 81)[:count])
            node = np.repeat(batch.column("node").to_numpy(), count)
            for at in range(0, len(node), 100_000):
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.reshape(-1)[at : at + 100_000].view(np.int64)), "node": pa.array(node[at : at + 100_000])})

    return nodes.select("node", "sketch").mapInArrow(run, "key bigint, node bigint")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (registers in rows) of sets of known sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u, v) / np.maximum(u, v)
    grid = np.linspace(0, 1, 101)[:, None] * most

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (1 - 1 / BASE)) / np.log(BASE), 1e-12)

    up, down = p(u - v * grid), p(v - u * grid)
    likelihood = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(grid, likelihood.argmax(axis=0)[None], 0)[0]


def _estimated(pairs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """(a, b, similarity) of the pairs whose estimate is not far below the threshold."""
    least = near.percent / 100 - near.margin
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * near.percent)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("s_a", "s_b"))
            guess = estimate(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            keep = np.flatnonzero(guess >= least)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(pa.array(keep)), "b": batch.column("b").take(pa.array(keep)), "similarity": pa.array(guess[keep])})

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Sorted shingle hashes of the wanted documents; up to ``BROADCAST_IDS`` ids, texts are filtered where they are read."""
    ids = settle(wanted.select(F.col("node").alias("doc_id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for a, b, data, offsets in blocks(batch.column("text")):
            rows, h = shingle_sets(data, offsets, words)
            cut = np.searchsorted(rows, np.arange(b - a + 1))
            out += [h[x:y].tobytes() for x, y in zip(cut, cut[1:])]
        return pa.RecordBatch.from_pydict({"node": batch.column("doc_id").cast(pa.int64()), "shingles": pa.array(out, pa.binary())})

    return over_texts(docs.join(ids, "doc_id", "left_semi"), "node bigint, shingles binary", work)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            good = []
            for k, (a, b) in enumerate(zip(batch.column("s_a"), batch.column("s_b"))):
                x, y = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                shared = int((y[at] == x).sum()) if len(x) and len(y) else 0
                if 100 * shared >= percent * (len(x) + len(y) - shared) and shared:
                    good.append(k)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(at), "b": batch.column("b").take(at)})

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def _relabelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the component of each end (itself where it has none)."""
    for x in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")), x, "left")
    return pairs.withColumn("c_a", F.coalesce("c_a", "a")).withColumn("c_b", F.coalesce("c_b", "b"))


def _mixed(members: DataFrame) -> DataFrame:
    """Members (key, node, c, ...) of buckets that hold more than one component."""
    several = members.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    return members.join(several, "key", "left_semi")


def _unmet(active: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """(a, b) of nodes (node, c, n) in different components that can be similar enough: an exact prefix filter.

    The shingles of a set stand in order of rarity. Two similar sets share one
    among the first n - ceil(t * n) + 1 of both, and the first they share
    leaves enough behind it in both: min(n_a - place, n_b - place) >= t / (1 + t) * (n_a + n_b).
    Outliers of a large family of near copies have many rare shingles, so the
    common ones come too late in their order to pair them with the family.
    """
    sets = _sets(docs, active.select("node"), near.words)
    t = near.percent

    def run(batches):
        for batch in batches:
            for node, shingles in zip(batch.column("node").to_pylist(), batch.column("shingles")):
                own = np.frombuffer(shingles.as_buffer(), np.int64)
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.full(len(own), node)), "shingle": pa.array(own)})

    rows = settle(sets.mapInArrow(run, "node bigint, shingle bigint").distinct())
    often = rows.groupBy("shingle").agg(F.count("*").alias("k"))
    order = Window.partitionBy("node").orderBy("k", "shingle")
    placed = rows.join(often, "shingle").withColumn("at", F.row_number().over(order) - 1).join(active, "node")
    prefix = placed.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * t / 100)) & (F.col("k") > 1))
    prefix = settle(prefix.select("shingle", "node", "c", "n", "at"))
    by = prefix.groupBy("shingle").agg(F.min("n").alias("n0"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    enough = lambda least, n: least * (100 + t) >= n * t
    able = settle(prefix.join(by.select("shingle", "n0"), "shingle").where(enough(F.col("n") - F.col("at"), F.col("n") + F.col("n0"))).drop("n0"))
    x, y = (able.select("shingle", *(F.col(k).alias(f"{k}_{i}") for k in ("node", "c", "n", "at"))) for i in "ab")
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    met = (F.col("node_a") < F.col("node_b")) & (F.col("c_a") != F.col("c_b")) & enough(left, F.col("n_a") + F.col("n_b"))
    return x.join(y, "shingle").where(met).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_components(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """Set size, component and whether it is kept (the smallest of its component) of each row of ``docs`` (``doc_id``, ``text``)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = settle(sketch_documents(docs, near.words))
    known = every.where("doc_id is not null and n > 0")
    nodes = settle(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    rows = _bands(nodes, near.band)
    ends = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    buckets = settle(rows.join(ends, "key"))
    pair = lambda x, y: buckets.where(F.col(x) < F.col(y)).select(F.col(x).alias("a"), F.col(y).alias("b"))
    tested = settle(pair("low", "node").unionByName(pair("node", "high")).distinct())
    likely = settle(_estimated(tested, nodes, near))
    sets = settle(_sets(docs, likely.select(F.explode(F.array("a", "b")).alias("node")), near.words))

    best = likely.groupBy("b").agg(F.max(F.struct("similarity", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
    links = settle(_confirmed(best, sets, near.percent))
    labels = settle(components(links))
    left = _relabelled(likely.join(best, ["a", "b"], "left_anti"), labels).where("c_a <> c_b")
    links = links.unionByName(settle(_confirmed(left, sets, near.percent)))
    labels = settle(components(links))

    # members of a bucket in different components that have not met
    named = _mixed(buckets.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")))
    active = settle(named.select("node", "c").distinct().join(nodes.select("node", "n"), "node"))
    fresh = _unmet(active, docs, near).join(tested, ["a", "b"], "left_anti")
    more = settle(_estimated(fresh, nodes, near))
    if not more.isEmpty():
        extra = _sets(docs, more.select(F.explode(F.array("a", "b")).alias("node")), near.words)
        labels = settle(components(links.unionByName(_confirmed(more, settle(extra), near.percent))))

    named = nodes.select("hi", "lo", "node").join(labels, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component"))
    found = every.where("n > 0").join(named, ["hi", "lo"], "left").select("doc_id", "n", "component")
    out = found.unionByName(every.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component"))).alias("kept"))

"""Benchmark decontamination by SimHash windows (operator 7).

A text is lower-cased, its words are the runs of letters and digits. For each
item, every window of as many words is compared with it: a 64-bit SimHash of
the window's five-word shingles (counts as weights) comes from running sums of
bits. The fingerprints of the items are indexed in eight blocks of a byte. Of
two fingerprints within ``radius`` bits, some block differs by at most
radius // 8 bits; the index holds each item under all such values, so it gives
every item within the radius. Candidates are verified by the exact weighted
similarity of the shingle multisets: shared weight / joint weight. A text with
fewer words than the item has no such window and is compared as a whole, if it has
enough shingles to reach the threshold.

A window without any shingle of an item has similarity 0, so the index is asked
only for the items that share a shingle with a window, and windows without such
an item are not fingerprinted. The benchmark goes to the tasks in slices of at
most ``slice_items`` items and ``slice_words`` words (longer benchmarks take more
passes, one after the other), which bounds what is broadcast.

Items shorter than five words are one shingle. Empty or null items and texts
match nothing. Null ids take no part. Equal items each get their rows; repeated
rows of documents give one row a pair.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.flat import U64, _BYTE, blocks, covered, factors, mix, over_texts, run_hashes, runs
from tidemark.llm.pieces import gather
from tidemark.session import settle

MATCHES = "doc_id bigint, item_id bigint, similarity double, start_word bigint, n_words bigint, distance int"
BITS, BLOCKS = 64, 8
PAIRS, SUMS = 1_000_000, 100_000  # window-item pairs and shingle sums held at once
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)
#: Four of five shingles differ by 12 bits on average, all larger sets at 0.8 by about 10: such whole texts are searched wider.
TINY, WIDER = 5, 4


@dataclass(frozen=True)
class Leak:
    """Words to a shingle, least similarity, radius of the fingerprint search, size of a benchmark slice."""

    words: int = 5
    least: float = 0.8
    radius: int = 23
    slice_items: int = 10_000
    slice_words: int = 2_000_000


class _Words:
    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = IN_WORD[data]
        self.starts, self.ends, self.rows = runs(inside, offsets)
        values = _BYTE[3][data]
        values[~inside] = 0
        self.h = run_hashes(values, self.starts, self.ends, 4)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all k-word shingles."""
        m = len(self.h) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        total = np.zeros(m, U64)
        for j, f in enumerate(factors(k, 60)[:k]):
            total += self.h[j : j + m] * f
        at = np.flatnonzero(self.rows[:m] == self.rows[k - 1 :])
        return at, mix(total[at] + U64(k))


def signs(shingles: np.ndarray) -> np.ndarray:
    """Bits of each hash as -1 and 1."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Bytes of the SimHash of sums of signs."""
    return np.packbits(sums >= 0, axis=1)


def run_prints(h: np.ndarray, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Fingerprints of the runs of ``size`` shingles from each of ``begin``."""
    need = np.flatnonzero(covered(begin, size, len(h)))
    sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(signs(h[need]), axis=0, dtype=np.int32)))
    low = np.searchsorted(need, begin)
    return fingerprints(sums[low + size] - sums[low])


def parts(begin: np.ndarray, size: np.ndarray, most: int = SUMS) -> list[np.ndarray]:
    """Ascending ``begin`` in stretches whose runs cover about ``most`` shingles at most."""
    if not len(begin):
        return []
    gaps = np.diff(begin, append=begin[-1] + size[-1])
    covers = np.cumsum(np.minimum(gaps, size)) // most
    return np.split(np.arange(len(begin)), np.flatnonzero(np.diff(covers)) + 1)


class Postings:
    """Items by shingle."""

    def __init__(self, sets: list[Counter]):
        h = np.concatenate([np.fromiter(s, U64, len(s)) for s in sets])
        item = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.lexsort((item, h))
        self.keys, self.starts = np.unique(h[order], return_index=True)
        self.items, self.ends = item[order], np.append(self.starts[1:], len(order))

    def found(self, h: np.ndarray):
        """(places in ``h``, items) that share a shingle, in pieces of about ``PAIRS`` pairs."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        place = np.flatnonzero(self.keys[at] == h)
        start, count = self.starts[at[place]], (self.ends - self.starts)[at[place]]
        cut = np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1 if len(place) else []
        for p, s, c in zip(*(np.split(x, cut) for x in (place, start, count))):
            yield np.repeat(p, c), gather(self.items, s, c)[0]


class Bench:
    """Items of one slice: shingles, fingerprints and the block index by item length."""

    def __init__(self, ids: list[int], texts: list[str], leak: Leak):
        self.leak = leak
        raw = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
        words = _Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        size = np.bincount(words.rows, minlength=len(raw))
        self.ids, self.sets, self.lengths = ids, {}, {}
        grams = {k: words.shingles(k) for k in {min(leak.words, int(n)) for n in size if n}}
        known: dict[int, list[np.ndarray]] = {}
        for k, (at, h) in grams.items():
            order = words.rows[at]
            for item in np.flatnonzero((size >= k) if k == leak.words else (size == k)):
                own = h[np.searchsorted(order, item) : np.searchsorted(order, item, "right")]
                self.sets[int(item)] = Counter(own.tolist())
                self.lengths.setdefault(int(size[item]), []).append(int(item))
                known.setdefault(k, []).append(own)
        self.known = {k: np.unique(np.concatenate(h)) for k, h in known.items()}
        self.prints, self.index, self.compared = {}, {}, 0
        self.posts = {n: Postings([self.sets[i] for i in items]) for n, items in self.lengths.items()}
        apart = POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)]
        for n, items in self.lengths.items():
            own = [np.array(list(self.sets[i].elements()), U64) for i in items]
            self.prints[n] = np.vstack([fingerprints(signs(h).sum(axis=0)[None]) for h in own])
            near = apart <= self.radius(n, True) // BLOCKS
            self.index[n] = [near[self.prints[n][:, b]].T.copy() for b in range(BLOCKS)]  # value of a block -> items

    def radius(self, n: int, whole: bool) -> int:
        """Search radius for items of ``n`` words."""
        return self.leak.radius + (WIDER if whole and n - min(self.leak.words, n) + 1 == TINY else 0)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int, int, int]]:
        """(row, item, similarity, first word, words, distance): the best window of each item in each row, or the whole row if it is shorter."""
        words = _Words(data, offsets)
        best: dict[tuple[int, int], tuple] = {}
        for k, known in self.known.items():
            at, h = words.shingles(k)
            if not len(h):
                continue
            hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            if not hit.any():
                continue
            rows = words.rows[at]
            touched = np.isin(rows, rows[hit])  # shingles of rows with a hit
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            size = np.diff(np.append(first, len(rows)))
            number = np.cumsum(np.append(True, rows[1:] != rows[:-1])) - 1  # of the row among those with shingles
            for n in self.lengths:
                span = n - k + 1  # shingles in a window of n words
                if min(self.leak.words, n) != k:
                    continue
                for place, item in self.posts[n].found(np.where(touched, h, U64(0))):
                    row = number[place]
                    short = (size[row] < span) & (size[row] / span >= self.leak.least)
                    whole = np.unique(np.stack((row[short], item[short])), axis=1) if short.any() else np.zeros((2, 0), np.int64)
                    self._compare(first[whole[0]], size[whole[0]], whole[1], n, at, h, rows, words, best)
                    self._windows(place, item, first[row], first[row] + size[row], span, n, at, h, rows, words, best)
        return [(row, item, *value) for (row, item), value in sorted(best.items())]

    def _windows(self, place, item, lo, hi, span, n, *rest) -> None:
        """Windows of ``span`` shingles inside lo..hi over each place, each once for an item."""
        order = np.lexsort((place, item))
        place, item, lo, hi = (x[order] for x in (place, item, lo, hi))
        before = np.where(np.diff(item, prepend=-1) == 0, np.concatenate(([0], place[:-1])), -1)
        begin = np.maximum(np.maximum(place - span + 1, before + 1), lo)
        count = np.maximum(np.minimum(place, hi - span) - begin + 1, 0)
        cuts = np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1 if len(count) else []
        for b, c, i in zip(*(np.split(x, cuts) for x in (begin, count, item))):
            ends = np.cumsum(c)
            if len(ends) and ends[-1]:
                window = np.arange(ends[-1]) + np.repeat(b - ends + c, c)
                self._compare(window, np.full(len(window), span), np.repeat(i, c), n, *rest)

    def _compare(self, begin, size, item, n, at, h, rows, words, best) -> None:
        """Ask the index about pairs of window and item; verify those within the radius."""
        span, items = n - min(self.leak.words, n) + 1, self.lengths[n]
        self.compared += len(begin)
        windows, first, pair = np.unique(begin, return_index=True, return_inverse=True)
        prints = np.zeros((len(windows), BLOCKS), np.uint8)
        for part in parts(windows, size[first]):
            prints[part] = run_prints(h, windows[part], size[first][part])
        maybe = np.zeros(len(begin), bool)
        for b in range(BLOCKS):
            maybe |= self.index[n][b][prints[pair, b], item]
        begin, size, item, pair = begin[maybe], size[maybe], item[maybe], pair[maybe]
        distance = POPCOUNT[prints[pair] ^ self.prints[n][item]].sum(axis=1)
        within = distance <= np.where(size < span, self.radius(n, True), self.radius(n, False))
        for start, here, i, d in zip(*(x[within].tolist() for x in (begin, size, item, distance))):
            own = self.sets[items[i]]
            shared = sum((own & Counter(h[start : start + here].tolist())).values())
            similarity = shared / (here + span - shared)
            if similarity >= self.leak.least:
                row = int(rows[start])
                value = (similarity, int(at[start] - np.searchsorted(words.rows, row)), n - span + here, int(d))
                old = best.get((row, items[i]))
                if old is None or (value[0], -value[1]) > (old[0], -old[1]):
                    best[row, items[i]] = value


def _slices(bench: DataFrame, leak: Leak) -> list[Bench]:
    """The benchmark in slices of bounded size, each read by itself."""
    items = bench.select(F.col("item_id").cast("bigint").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where("item_id is not null and text is not null")
    count, words = items.agg(F.count("*"), F.sum(F.size(F.split("text", r"\s+")))).first()
    parts = max(1, -(-count // (leak.slice_items // 2)), -(-(words or 0) // (leak.slice_words // 2)))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield Bench([r.item_id for r in rows], [r.text for r in rows], leak)


def leaks(docs: DataFrame, bench: DataFrame, leak: Leak = Leak()) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, distance): documents that hold a window like a benchmark item."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).where("doc_id is not null")
    out, open_ = None, None
    for part in _slices(bench, leak):
        if open_ is not None:  # more than one slice: run it and free its broadcast before the next one
            out = _run(out, *open_)
        shared = docs.sparkSession.sparkContext.broadcast(part)
        open_ = over_texts(texts, MATCHES, _worker(shared)), shared
    if open_ is None:
        return docs.sparkSession.createDataFrame([], MATCHES)
    out = open_[0] if out is None else _run(out, *open_)
    best = F.max(F.struct("similarity", -F.col("start_word"), "n_words", "distance")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.similarity", (-F.col("m.col2")).alias("start_word"), "m.n_words", "m.distance")


def _run(out: DataFrame | None, found: DataFrame, shared) -> DataFrame:
    """Written results of a slice added to those before; the slice is freed."""
    found = settle(found)
    shared.destroy()
    return found if out is None else out.unionByName(found)


def _worker(shared):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = batch.column("doc_id").to_numpy(), []
        for lo, _, data, offsets in blocks(batch.column("text")):
            found += [(int(ids[lo + row]), shared.value.ids[item], *rest) for row, item, *rest in shared.value.matches(data, offsets)]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
        names = [x.split()[0] for x in MATCHES.split(", ")]
        columns = zip(*found) if found else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return work

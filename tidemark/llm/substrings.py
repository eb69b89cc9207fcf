"""Substring dedup with a count-min prefilter (operator 8).

A window is ``width`` consecutive words of one document. A word is removed if
a window over it also starts in a document with a smaller id. Three passes
over documents dealt into chunks of bounded size share one shuffle of texts:

1. Each chunk makes a partial count-min sketch of its windows: two rows of
   cells, each far wider than the number of windows. It is sparse, so only
   touched cells travel, cut by cell range. Adding the partial sketches of a
   range gives counts that never fall below the true ones; the chunk gets back
   a bit for each of its cells: counted twice or more.
2. Windows whose cells in both rows are counted twice may be repeated, all
   others are certainly not. Only the former are grouped exactly, by a 96-bit
   digest; each chunk sends a digest once, with its smallest document, so a
   passage in a third of all documents is one entry a chunk. Where another
   chunk has a smaller document, the chunk is told.
3. Each chunk removes the covered words.

Chunks, cell ranges and sketch width follow from one count over the table;
nothing is collected or broadcast. Rows with null ``doc_id`` keep all words and
take no part. Null and empty texts have no words. Rows with the same id don't
remove each other's words; each gets a row.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.flat import U64, Words, blocks, covered, small_batches
from tidemark.llm.pieces import gather

OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
SENT = "chunk bigint, part bigint, kind int, n bigint, data binary"
CHUNK_BYTES = 8 << 20
CELLS_EACH = 2 << 20
SPARE = 8  # cells of a sketch row for each window


class Plan:
    """Sizes that follow from the amount of text."""

    def __init__(self, total_bytes: int, width: int, chunk_bytes: int = CHUNK_BYTES, cells_each: int = CELLS_EACH):
        windows = max(total_bytes // 6, 1)
        self.width = width
        self.chunks = max(1, -(-total_bytes // chunk_bytes))
        self.row_bits = min(62, max(16, int(windows * SPARE - 1).bit_length()))
        self.part_bits = min(self.row_bits - 8, max(0, int(windows // cells_each).bit_length()))


def _windows(table: pa.Table, width: int):
    """Words of each block, first words and 64-bit hashes (two) of all windows, and the row of each."""
    held, h1, h2, rows, at = [], [], [], [], []
    for lo, _, data, offsets in blocks(table.column("text")):
        words = Words(data, offsets, (1, 2))
        first, a = words.windows(width, 0)
        h1.append(a)
        h2.append(words.windows(width, 1)[1])
        rows.append(words.rows[first] + lo)
        at.append(first)
        held.append((data, offsets, words))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return held, at, join(h1, U64), join(h2, U64), join(rows, np.int64)


def _rows(chunk: int, found: list[tuple[int, int, int, bytes]]) -> pa.Table:
    part, kind, n, data = zip(*found) if found else ((), (), (), ())
    return pa.table({"chunk": pa.array([chunk] * len(part), pa.int64()), "part": pa.array(part, pa.int64()), "kind": pa.array(kind, pa.int32()),
                     "n": pa.array(n, pa.int64()), "data": pa.array(data, pa.binary())})


def _answers(chunks: list[int], part: int, kind: int, found: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "part": pa.array([part] * len(chunks), pa.int64()), "kind": pa.array([kind] * len(chunks), pa.int32()),
                     "n": pa.array([n for n, _ in found], pa.int64()), "data": pa.array([d for _, d in found], pa.binary())})


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, in as few bytes as the largest needs."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    kind = np.uint16 if not len(steps) or steps.max() < 1 << 16 else np.uint32 if steps.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"u{data[0]}", offset=1).astype(U64), dtype=U64)


def _sketch(plan: Plan, table: pa.Table) -> pa.Table:
    """Touched cells of both rows of a chunk's sketch, by cell range; the low bit says counted twice in the chunk."""
    _, _, h1, h2, _ = _windows(table, plan.width)
    found = []
    for row, h in enumerate((h1, h2)):
        cells, count = np.unique(h >> U64(64 - plan.row_bits), return_counts=True)
        low = U64(plan.row_bits - plan.part_bits)
        part = (cells >> low).astype(np.int64)
        coded = ((cells - (part.astype(U64) << low)) << U64(1)) | (count > 1)
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(part))):
            found.append((row << plan.part_bits | int(part[a]), 0, int(b - a), _pack(coded[a:b])))
    return _rows(table.column("chunk")[0].as_py(), found)


def _add_sketches(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Counts of a cell range over all chunks; each chunk gets a bit for each cell it sent."""
    coded = [_unpack(d) for d in table.column("data").to_pylist()]
    every = np.concatenate(coded)
    cells, inverse = np.unique(every >> U64(1), return_inverse=True)
    twice = np.bincount(inverse, weights=1.0 + (every & U64(1)).astype(float), minlength=len(cells)) >= 2
    bits, at, found = twice[inverse], 0, []
    for c in coded:
        found.append((len(c), np.packbits(bits[at : at + len(c)]).tobytes()))
        at += len(c)
    return _answers(table.column("chunk").to_pylist(), key[0].as_py(), 1, found)


def _shrink(ids: np.ndarray) -> bytes:
    """Ids as differences to the smallest, in 4 bytes where they fit."""
    base = int(ids.min()) if len(ids) else 0
    wide = len(ids) and int(ids.max()) - base >= 1 << 32
    rest = (ids.astype(U64) - U64(base & (2**64 - 1))).astype("u8" if wide else "u4")
    return np.array([base], np.int64).tobytes() + bytes([8 if wide else 4]) + rest.tobytes()


def _grow(data: bytes) -> np.ndarray:
    return (np.frombuffer(data, f"u{data[8]}", offset=9).astype(U64) + np.frombuffer(data, np.int64, 1).astype(U64)).astype(np.int64)


def _candidates(plan: Plan, table: pa.Table, answers: pa.Table) -> pa.Table:
    """Digest and smallest document of the windows that the sketch counts twice or more, by digest range."""
    found: list = []
    if not table.num_rows or not answers.num_rows:
        return _rows(0, found)
    _, _, h1, h2, rows = _windows(table, plan.width)
    bits = {p: np.unpackbits(np.frombuffer(d, np.uint8))[:n] for p, n, d in zip(*(answers.column(c).to_pylist() for c in ("part", "n", "data")))}
    maybe = np.ones(len(h1), bool)
    for row, h in enumerate((h1, h2)):
        parts = [bits[p] for p in sorted(bits) if p >> plan.part_bits == row]
        inverse = np.unique(h >> U64(64 - plan.row_bits), return_inverse=True)[1]
        maybe &= np.concatenate(parts).astype(bool)[inverse]
    ids = table.column("doc_id").to_numpy()[rows[maybe]]
    h1, h2 = h1[maybe], (h2[maybe] >> U64(32)).astype(np.uint32)
    order = np.lexsort((ids, h2, h1))
    h1, h2, ids = h1[order], h2[order], ids[order]
    first = np.ones(len(h1), bool)
    first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    h1, h2, ids = h1[first], h2[first], ids[first]
    part = (h1 >> U64(64 - plan.part_bits)).astype(np.int64) if plan.part_bits else np.zeros(len(h1), np.int64)
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(part))):
        found.append((int(part[a]), 2, int(b - a), h1[a:b].tobytes() + h2[a:b].tobytes() + _shrink(ids[a:b])))
    return _rows(table.column("chunk")[0].as_py(), found)


def _group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Smallest document of each digest; a chunk is told where another chunk's is smaller than its own."""
    counts, blobs = table.column("n").to_pylist(), table.column("data").to_pylist()
    h1 = np.concatenate([np.frombuffer(d, U64, n) for n, d in zip(counts, blobs)])
    h2 = np.concatenate([np.frombuffer(d, np.uint32, n, 8 * n) for n, d in zip(counts, blobs)])
    ids = np.concatenate([_grow(d[12 * n :]) for n, d in zip(counts, blobs)])
    order = np.lexsort((ids, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    least = np.empty_like(ids)
    least[order] = ids[order[np.flatnonzero(new)[np.cumsum(new) - 1]]]
    at, found = 0, []
    for n in counts:
        told = np.flatnonzero(least[at : at + n] < ids[at : at + n]) + at
        found.append((len(told), h1[told].tobytes() + h2[told].tobytes() + _shrink(least[told])))
        at += n
    return _answers(table.column("chunk").to_pylist(), key[0].as_py(), 3, found)


def _remove(plan: Plan, with_text: bool, table: pa.Table, told: pa.Table) -> pa.Table:
    """Covered words out, document by document."""
    held, first, h1, h2, rows = _windows(table, plan.width)
    every = table.column("doc_id").to_numpy()
    ids, h2 = every[rows], (h2 >> U64(32)).astype(np.uint32)
    counts, blobs = told.column("n").to_pylist(), told.column("data").to_pylist()
    g1 = np.concatenate([h1, *(np.frombuffer(d, U64, n) for n, d in zip(counts, blobs))])
    g2 = np.concatenate([h2, *(np.frombuffer(d, np.uint32, n, 8 * n) for n, d in zip(counts, blobs))])
    g3 = np.concatenate([ids, *(_grow(d[12 * n :]) for n, d in zip(counts, blobs))])
    out = []
    hit = np.zeros(len(ids), bool)
    if len(g1):
        order = np.argsort(g1, kind="stable")
        same = g1[order[1:]] == g1[order[:-1]]
        if (same & (g2[order[1:]] != g2[order[:-1]])).any():  # equal in 64 bits but not in 96
            order = np.lexsort((g2, g1))
            same = (g1[order[1:]] == g1[order[:-1]]) & (g2[order[1:]] == g2[order[:-1]])
        start = np.flatnonzero(np.concatenate(([True], ~same)))
        least = np.repeat(np.minimum.reduceat(g3[order], start), np.diff(np.append(start, len(order))))
        mine = order < len(ids)
        hit[order[mine]] = least[mine] < ids[order[mine]]
    at = row = 0
    for (data, offsets, words), begin in zip(held, first):
        gone = covered(begin[hit[at : at + len(begin)]], plan.width, len(words))
        at += len(begin)
        removed = np.bincount(words.rows[gone], minlength=words.n_rows)
        kept = np.flatnonzero(~gone)
        text, ends = gather(np.append(data, np.uint8(32)), words.starts[kept], words.ends[kept] - words.starts[kept] + 1)
        text = np.array(text)
        text[ends - 1] = 32
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(words.counts - removed)))].tolist()
        raw = text.tobytes()
        texts = [raw[a : max(a, b - 1)] for a, b in zip(upto, upto[1:])]
        out.append(_result(every[row : row + words.n_rows], words.counts, removed, texts, with_text))
        row += words.n_rows
    return pa.concat_tables(out) if out else _result(every[:0], every[:0], every[:0], [], with_text)


def _result(ids, n_words, n_removed, texts: list[bytes], with_text: bool) -> pa.Table:
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            "kept_text": pa.array([t.decode() if with_text else None for t in texts], pa.string()),
        }
    )


def remove_repeated_windows(docs: DataFrame, width: int = 13, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, cells_each: int = CELLS_EACH) -> DataFrame:
    """Words, removed words and digest of the kept words of each row of ``docs`` (``doc_id``, ``text``); ``kept_text`` on demand."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(total, width, chunk_bytes, cells_each)
    known = rows.where("doc_id is not null")
    chunked = known.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(plan.chunks)))
    sketches = chunked.groupBy("chunk").applyInArrow(lambda table: _sketch(plan, table), SENT)
    bits = sketches.groupBy("part").applyInArrow(lambda key, table: _add_sketches(key, table), SENT)
    maybe = chunked.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(lambda table, answers: _candidates(plan, table, answers), SENT)
    told = maybe.groupBy("part").applyInArrow(lambda key, table: _group(key, table), SENT)
    found = chunked.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda table, answers: _remove(plan, with_text, table, answers), OUT)
    loose = rows.where("doc_id is null").mapInArrow(partial(_keep_all, with_text), OUT)
    out = found.unionByName(loose)
    return out if with_text else out.drop("kept_text")


def _keep_all(with_text: bool, batches):
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column("text")):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets, offsets[1:])]
            kept = [b" ".join(t.split()) for t in texts]
            counts = Words(data, offsets).counts
            yield from _result(np.full(hi - lo, 0), counts, np.zeros(hi - lo, np.int64), kept, with_text).set_column(
                0, "doc_id", pa.nulls(hi - lo, pa.int64())
            ).to_batches()

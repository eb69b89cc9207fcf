"""Token ids in binary files with keyed access by a minimal perfect hash (operator 11).

Files of a dataset folder, in ascending order of ``doc_id``:

* ``shard-N``: the raw ids of consecutive documents, each with its end id,
  little-endian, two bytes an id where the vocabulary allows it, else four.
* ``index-P``: a minimal perfect hash of one part of the document keys and, in
  the order of its numbers, fingerprint, shard, offset and length of each
  document (``HEAD`` and ``ENTRY``). A key costs a hash and one entry; a key
  that isn't held has another fingerprint (but for one in 2^32).
* ``keys``: Parquet table of the document keys; ``shards``: of the files, with
  the number of ids before each.

A document's key is its ``doc_id`` and the number of rows with the same id
before it, so equal ids keep a row each: they are ordered by a hash of their
text and then as they come. Rows with null ``doc_id`` come first. Null and
empty texts hold the end id alone. An empty table gives tables without rows.
Texts are range-partitioned by id, text hash and row, so no id has a task of
its own; each task writes one shard. Files get their name when they are whole,
so a task that runs again replaces them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.flat import U64, small_batches
from tidemark.llm.library_words import LibraryEncoder
from tidemark.llm.perfect_hash import PerfectHash, pair_hash
from tidemark.llm.shared_files import make_folder, new_file, open_file
from tidemark.session import settle

ENTRIES = "doc_id bigint, nth bigint, shard int, row bigint, offset bigint, length bigint"
FOUND = "doc_id bigint, copy bigint, shard int, offset bigint, length bigint"
DOCUMENTS = "doc_id bigint, copy bigint, start bigint, ids binary"
HEAD = struct.Struct("<8sqq")  # mark, keys, levels; then words of each level, the levels, the entries
ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])
MARK = b"mphash01"
NULL_KEY = 1 << 62  # added to the copy number of rows without an id
PRINT_SEED = 1 << 20


@dataclass(frozen=True)
class Sizes:
    """``shard_bytes``: text of a shard, which grows with the data up to ``most_bytes``; ``part_keys``: keys of an index file."""

    shard_bytes: int = 32 << 20
    most_bytes: int = 512 << 20
    shards: int = 5000
    part_keys: int = 200_000


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    parts: int
    width: int


def _key_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids, copies = batch.column("doc_id"), batch.column("copy").to_numpy(zero_copy_only=False)
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64), (copies.astype(np.int64) + NULL_KEY * missing).view(U64)


def _part(parts: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(parts)).cast("int")


def part_of(doc_id: int | None, copy: int, parts: int) -> int:
    """Index file of a key: the same hash as Spark's, whose seed for a column is the hash of those before."""
    h = 42
    for x in (doc_id, copy):
        if x is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    return (h - (h >> 63 << 64)) % parts


def _write_shards(folder: str, encoder, end_id: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId()
    rows = offset = nth = 0
    before: object = TokenFiles  # unlike any id
    filled = (b for b in batches if b.num_rows)
    first = next(filled, None)
    if first is None:
        return
    with new_file(f"{folder}/shard-{number:06d}") as out:
        while first is not None:
            ids, counts = encoder.value.encode(first.column("text"))
            ends = np.cumsum(counts)
            whole = np.insert(ids, ends, end_id).astype(f"<u{width}")
            out.write(whole.tobytes())
            told, nths = first.column("doc_id").to_pylist(), []
            for d in told:
                nth, before = (nth + 1 if d == before else 0), d
                nths.append(nth)
            starts = offset + ends - counts + np.arange(len(ends))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": first.column("doc_id"), "nth": pa.array(nths, pa.int64()), "shard": pa.array([number] * len(told), pa.int32()),
                 "row": pa.array(np.arange(rows, rows + len(told)), pa.int64()), "offset": pa.array(starts, pa.int64()), "length": pa.array(counts + 1, pa.int64())}
            )
            rows, offset = rows + len(told), offset + len(whole)
            first = next(filled, None)


def _shard_table(entries: DataFrame) -> DataFrame:
    """Per shard the ids before it, and the rows in earlier shards that have the id it begins with."""
    whole = entries.groupBy("shard").agg(
        F.sum("length").alias("n_ids"), F.count("*").alias("n_rows"), F.min(F.struct("row", "doc_id"))["doc_id"].alias("begins"), F.max(F.struct("row", "doc_id", "nth")).alias("last")
    )
    tails = whole.select(F.col("last.doc_id").alias("id"), "shard", F.lit(1).alias("kind"), (F.col("last.nth") + 1).alias("tail"))
    heads = whole.select(F.col("begins").alias("id"), "shard", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("tail"))
    run = Window.partitionBy("id").orderBy("shard", "kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = tails.unionByName(heads).withColumn("carried", F.sum("tail").over(run)).where("kind = 0").select("shard", "carried")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return whole.join(carried, "shard").select("shard", "n_ids", "n_rows", "carried", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("ids_before"))


def _write_part(folder: str, part: int, index: PerfectHash, entries: np.ndarray) -> None:
    with new_file(f"{folder}/index-{part:06d}") as out:
        out.write(HEAD.pack(MARK, len(entries), len(index.levels)))
        out.write(np.array([len(x) for x in index.levels], "<i8").tobytes())
        for x in index.levels:
            out.write(x.tobytes())
        out.write(entries.tobytes())


def _write_index(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file for each part; rows come sorted by part."""
    held: list[pa.RecordBatch] = []

    def close() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        part, (a, b) = table.column("part")[0].as_py(), _key_arrays(table)
        index = PerfectHash.build(a, b)
        entries = np.zeros(len(a), ENTRY)
        at = index.numbers(a, b)
        entries["print"][at] = pair_hash(a, b, PRINT_SEED).astype(np.uint32)
        for name in ("shard", "offset", "length"):
            entries[name][at] = table.column(name).to_numpy()
        _write_part(folder, part, index, entries)
        held.clear()
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_keys": pa.array([len(a)], pa.int64())})

    for batch in batches:
        parts = batch.column("part").to_numpy()
        for lo, hi in _stretches(parts):
            if held and held[0].column("part")[0].as_py() != parts[lo]:
                yield close()
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield close()


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
    return list(zip(cut.tolist(), np.append(cut[1:], len(values)).tolist()))


class Index:
    """An index file."""

    def __init__(self, folder: str, part: int):
        with open_file(f"{folder}/index-{part:06d}") as f:
            data = f.read()
        mark, keys, n = HEAD.unpack_from(data)
        if mark != MARK:
            raise ValueError("not an index file")
        at, levels = HEAD.size + 8 * n, []
        for size in np.frombuffer(data, "<i8", n, HEAD.size).tolist():
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        self.hash, self.entries = PerfectHash(levels), np.frombuffer(data, ENTRY, keys, at)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the keys, and whether each is held."""
        at = self.hash.numbers(a, b)
        found = self.entries[np.maximum(at, 0)] if len(self.entries) else np.zeros(len(a), ENTRY)
        return found, (at >= 0) & (found["print"] == pair_hash(a, b, PRINT_SEED).astype(np.uint32))


def _look_up(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of keys that come sorted by part; keys that aren't held get nulls."""
    part, index = None, None
    for batch in batches:
        parts = batch.column("part").to_numpy()
        for lo, hi in _stretches(parts):
            if part != parts[lo]:
                part, index = parts[lo], Index(folder, int(parts[lo]))
            rows = batch.slice(lo, hi - lo)
            found, held = index.find(*_key_arrays(rows))
            columns = {"doc_id": rows.column("doc_id"), "copy": rows.column("copy")}
            for name, kind in (("shard", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())):
                columns[name] = pa.array(found[name].astype(kind.to_pandas_dtype()), kind, mask=~held)
            yield pa.RecordBatch.from_pydict(columns)


def _read_ids(folder: str, width: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads of entries that come sorted by shard and offset, four bytes an id."""
    shard = file = None
    for batch in batches:
        length = batch.column("length").to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(length) // most, prepend=-1))  # batches of about ``most`` ids
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(length)).tolist()):
            rows, ids = batch.slice(lo, hi - lo), []
            for number, offset, n in zip(*(rows.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                if number != shard:
                    if file:
                        file.close()
                    shard, file = number, open_file(f"{folder}/shard-{number:06d}")
                ids.append(np.frombuffer(file.read_at(n * width, offset * width), f"<u{width}").astype("<u4").tobytes())
            start = pa.array(rows.column("ids_before").to_numpy() + rows.column("offset").to_numpy(), pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "copy": rows.column("copy"), "start": start, "ids": pa.array(ids, pa.binary())})
    if file:
        file.close()


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 1, sizes: Sizes | None = None) -> TokenFiles:
    """Write the ids of each row of ``docs`` (``doc_id``, ``text``) into a new dataset folder; ``path``: a tokenizer file."""
    spark, sizes = docs.sparkSession, sizes or Sizes()
    small_batches(spark)
    make_folder(folder)
    encoder = LibraryEncoder(path)
    width = 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4
    shared = spark.sparkContext.broadcast(encoder)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_rows, n_bytes = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-n_bytes // max(sizes.shard_bytes, min(sizes.most_bytes, n_bytes // sizes.shards))))
    parts = max(1, -(-n_rows // sizes.part_keys))
    order = ["doc_id", "tie", "seq"]
    rows = texts.withColumn("tie", F.xxhash64("text")).withColumn("seq", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(int(shards), *order).sortWithinPartitions(*order).select("doc_id", "text")
    entries = settle(ordered.mapInArrow(lambda b: _write_shards(folder, shared, end_id, width, b), ENTRIES))
    _shard_table(entries).write.parquet(f"{folder}/shards")
    table = spark.read.parquet(f"{folder}/shards")
    copy = F.col("nth") + F.when(F.col("nth") == F.col("row"), F.col("carried")).otherwise(0)
    keyed = entries.join(F.broadcast(table.select("shard", "carried")), "shard").withColumn("copy", copy)
    keyed.select("doc_id", "copy", "shard", "offset", "length").write.parquet(f"{folder}/keys")
    keys = spark.read.parquet(f"{folder}/keys").withColumn("part", _part(parts))
    by_part = keys.repartition(int(parts), "part").sortWithinPartitions("part")
    by_part.mapInArrow(lambda b: _write_index(folder, b), "part int, n_keys bigint").write.parquet(f"{folder}/parts")
    filled = spark.read.parquet(f"{folder}/parts").select(F.col("part").cast("bigint").alias("id"))
    for empty in spark.range(int(parts)).join(filled, "id", "left_anti").collect():  # of small tables: parts no key fell into
        _write_part(folder, empty["id"], PerfectHash([]), np.zeros(0, ENTRY))
    return TokenFiles(folder, int(parts), width)


def look_up(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """Shard, offset and length of each key (``doc_id``, ``copy``) through the index; nulls where it isn't held."""
    asked = keys.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("copy").cast("bigint").alias("copy")).withColumn("part", _part(files.parts))
    return asked.repartition(files.parts, "part").sortWithinPartitions("part").mapInArrow(lambda b: _look_up(files.folder, b), FOUND)


def read_token_files(spark: SparkSession, files: TokenFiles, keys: DataFrame | None = None, most: int = 1 << 20) -> DataFrame:
    """(doc_id, copy, start, ids) of the given keys, or of all, through index and shards; ``ids``: four bytes each, little-endian."""
    keys = spark.read.parquet(f"{files.folder}/keys").select("doc_id", "copy") if keys is None else keys
    table = spark.read.parquet(f"{files.folder}/shards").select("shard", "ids_before")
    found = look_up(files, keys).where("shard is not null").join(F.broadcast(table), "shard")
    placed = found.repartition("shard", F.floor(F.col("offset") / (16 * most))).sortWithinPartitions("shard", "offset")
    return placed.mapInArrow(lambda b: _read_ids(files.folder, files.width, most, b), DOCUMENTS)


def ids_of(files: TokenFiles, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
    """Ids of one document: one index file, one entry, one read."""
    missing = doc_id is None
    a, b = np.array([0 if missing else doc_id], np.int64).view(U64), np.array([copy + NULL_KEY * missing], np.int64).view(U64)
    (entry,), (held,) = Index(files.folder, part_of(doc_id, copy, files.parts)).find(a, b)
    if not held:
        return None
    with open_file(f"{files.folder}/shard-{entry['shard']:06d}") as f:
        return np.frombuffer(f.read_at(int(entry["length"]) * files.width, int(entry["offset"]) * files.width), f"<u{files.width}")

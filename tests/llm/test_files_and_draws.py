"""Token files, the dataset manifest and importance resampling against brute force."""

import hashlib
import math
import random
import re
import tempfile
import zlib

import edges
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import importance, merkle, token_files
from tidemark.llm.importance import Draw, resample
from tidemark.llm.interning import Interned, xxhash64
from tidemark.llm.library_words import LibraryEncoder
from tidemark.llm.merkle import Shape, manifest
from tidemark.llm.perfect_hash import PerfectHash
from tidemark.llm.token_files import Sizes, ids_of, look_up, part_of, read_token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["'", "s", "'ll", " ", "  ", "\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "é", "é", "́", "İ", "Σ", "ς", "1", "½", "Hello", "!!", "<|endoftext|>", "<|startoftext|>", "日本", "👍", "_", "don't", "\t", "가"]
TIGHT = Sizes(shard_bytes=3_000, part_keys=7)


def mixed(n, size, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def folder():
    return f"{tempfile.mkdtemp(prefix='spark-')}/set"


def test_words_give_the_ids_of_whole_texts(library):
    import pyarrow as pa

    texts = [*mixed(2000, 14), *mixed(30, 900, 2), None, "", "x" * 200_000]
    encoder = LibraryEncoder(PATH)
    for _ in range(2):  # the second time from memory
        ids, counts = encoder.encode(pa.array(texts))
        at = 0
        for text, n in zip(texts, counts):
            assert ids[at : at + n].tolist() == library.encode(text or "", add_special_tokens=False).ids, (text or "")[:80]
            at += n


def test_files_come_back_in_order(spark, library):
    rows = edges.ROWS + [(100 + i % 60, t) for i, t in enumerate(mixed(200, 14))] + [(77, "the same row")] * 300
    files = write_token_files(edges.frame(spark, rows).repartition(5), PATH, folder(), sizes=TIGHT)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.copy, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_files(spark, files).collect())
    assert spark.read.parquet(f"{files.folder}/shards").count() > 3 and files.parts > 3 and files.width == 2
    start, copies = 0, {}
    for key, copy, at, ids in got:
        assert (copy, at) == (copies.get(key, 0), start)
        copies[key] = copy + 1
        start += len(ids)
    want = sorted(((d is not None, d or 0), library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows)
    assert sorted((k, ids) for k, _, _, ids in got) == want
    for key, copy, _, ids in random.Random(2).sample(got, 25):
        assert ids_of(files, key[1] if key[0] else None, copy).tolist() == ids
    assert ids_of(files, 10**12) is None and ids_of(files, 77, 9999) is None
    asked = look_up(files, spark.createDataFrame([(5, 0), (5, 3), (-1, 0)], "doc_id bigint, copy bigint"))
    assert {(r.doc_id, r.copy): r.shard is not None for r in asked.collect()} == {(5, 0): True, (5, 3): False, (-1, 0): False}


def test_files_of_an_empty_table(spark):
    files = write_token_files(edges.frame(spark, []), PATH, folder())
    assert read_token_files(spark, files).count() == 0 and ids_of(files, 1) is None


def test_parts_are_sparks(spark):
    keys = [(d, c) for d in (None, 0, -5, 2**63 - 1, 12345) for c in (0, 1, 70_000)]
    rows = spark.createDataFrame(keys, "doc_id bigint, copy bigint").select("*", token_files._part(97).alias("part")).collect()
    assert all(r.part == part_of(r.doc_id, r.copy, 97) for r in rows)


def test_perfect_hash():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 65, 20_000):
        a, b = rnd.integers(0, max(1, n // 4), n).astype(np.uint64), np.arange(n).astype(np.uint64)
        assert sorted(PerfectHash.build(a, b).numbers(a, b).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([1, 1], np.uint64), np.array([1, 1], np.uint64))


# --- manifest ---


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, arity):
    """Root, and for each leaf the (left, right) siblings of each level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            lo = p - p % arity
            ways[k].append((nodes[lo:p], nodes[p + 1 : lo + arity]))
        nodes = [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        at = [p // arity for p in at]
    return nodes[0], ways


def brute_manifest(rows, arity):
    def leaf(d, source, lang, n, text):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[2] == lang)
        trees.append((own, *tree([x[2] for x in own], arity)))
    root, tops = tree([t[1] for t in trees], arity)
    out = []
    for (own, subroot, ways), top in zip(trees, tops):
        for (_, _, h, r), way in zip(own, ways):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at = leaf(*r[:3], r[3] + 1 if hit and r[3] is not None else r[3], r[4])
            for left, right in way + top:
                at = digest(*left, at, *right)
            out.append((r[0], h, subroot, root, digest(*(x for left, right in way + top for x in left + right)), at, at == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity,levels", [(2, 1), (2, 3), (3, 2), (2, 12)])
@pytest.mark.parametrize("langs", [["en"], ["en", None, "", "é", "zz", "Z"]])
def test_manifest_equals_brute_force(spark, arity, levels, langs):
    rnd = random.Random(arity + levels)
    rows = [(i - 5, rnd.choice(["a", None, "ü"]), langs[min(rnd.randrange(40), len(langs) - 1)], rnd.choice([None, i]), rnd.choice(["", None, "日本", f"t{i}"])) for i in range(150)]
    rows += [(None, None, langs[0], None, None)] * 2 + [rows[3]] * 3 + [(rows[7][0], "other", langs[0], 1, "x")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, place int, digest string, tree int")
    out = manifest(docs.repartition(3), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, Shape(arity, levels))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_manifest(rows, arity)


def test_manifest_edges(spark):
    kind = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    assert manifest(spark.createDataFrame([], kind)).count() == 0
    (r,) = manifest(spark.createDataFrame([(1, None, None, None, "x" * 300_000)], kind)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == digest("")


def test_states_resume_as_a_whole_hash():
    block = merkle.Block([digest(str(k)) for k in range(11)], 3, 3)
    other = digest("other").encode()
    for k in range(11):
        nodes = [digest(str(j)) for j in range(11)]
        nodes[k] = other.decode()
        assert block.fold(k, other) == merkle.Block(nodes, 3, 3).root


# --- resampling ---


def test_hashes_and_table():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 45))).encode() for _ in range(3000)] + [b"", b"a"] * 50
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    hashes = xxhash64(data, start, size)
    assert hashes.tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    for given in (None, np.zeros(len(words), np.uint64), hashes % np.uint64(7)):  # also where all hashes collide
        if given is not None:
            given, keep = given[:300], 300
        else:
            keep = len(words)
        table = Interned(data, start[:keep], size[:keep], given)
        slots = {}
        for w, s in zip(words[:keep], table.slot.tolist()):
            assert slots.setdefault(w, s) == s
        assert len(set(slots.values())) == len(slots) == len(table.used)
        assert table.count[table.used].sum() == keep


def brute_draw(rows, target, draw):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + k]) for k in range(draw.least, draw.most + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(g.encode()) % draw.buckets for g in grams]

    def counted(texts):
        n = [0] * draw.buckets
        for t in texts:
            for b in features(t)[1]:
                n[b] += 1
        return n

    s, t = counted(x for _, x in rows), counted(target)
    big_s, big_t = sum(s), sum(t)
    gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + draw.buckets) / ((s[b] + 1) * (big_t + draw.buckets)))) for b in range(draw.buckets)]
    out = []
    for d, x in rows:
        n, found = features(x)
        weight = sum(gains[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{draw.seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((-r[3], r[0] is None, r[0] or 0, r[1], r[2], k) for k, r in enumerate(out) if r[4] >= draw.min_words)
    rank = {x[-1]: k + 1 for k, x in enumerate(fit[: draw.percent * len(fit) // 100])}
    return sorted([(*r[:4], rank.get(k)) for k, r in enumerate(out)], key=str)


@pytest.mark.parametrize("draw", [Draw(), Draw(least=1, most=3, buckets=50, percent=35, min_words=5)])
def test_draw_equals_brute_force(spark, draw):
    rnd = random.Random(6)
    text = lambda: " ".join(rnd.choice(["The", "river's", "MILL", "é日本", "a1", "--", "x_y", "ÀÉ", "\x7f", "w" * 40]) for _ in range(rnd.randint(0, 60)))
    rows = edges.ROWS + [(1000 + i, text()) for i in range(200)] + [(1000, "a b c " * 30)] * 3
    target = [text() for _ in range(20)] + [None]
    out = resample(edges.frame(spark, rows), spark.createDataFrame([(t, 1) for t in target], "text string, bucket int"), draw)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_draw(rows, target, draw)


def test_draw_from_nothing(spark):
    empty = edges.frame(spark, [])
    assert resample(empty, empty).count() == 0
    assert {r["rank"] for r in resample(edges.frame(spark), empty).collect()} == {None}  # too few texts for a tenth
    assert importance.gumbel(None, Draw()) == importance.gumbel(None, Draw())

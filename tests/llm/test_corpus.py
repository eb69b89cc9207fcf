"""Operators that compare texts with each other, the graph helper, and the pipeline."""

import random
from collections import Counter

import edges
import pytest

import corpus_pipeline
from tidemark.llm.components import components
from tidemark.llm.decontaminate import Leak, leaks
from tidemark.llm.line_runs import without_later_copies
from tidemark.llm.setsketch import Near, near_components
from tidemark.llm.substrings import remove_repeated_windows


def words(rnd, n, of=2000):
    return [f"w{rnd.randrange(of)}" for _ in range(n)]


def varied(rnd, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"y{rnd.randrange(99)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def families():
    """Texts in families of near copies of rising distance, some passages shared."""
    rnd, rows = random.Random(4), []
    for _ in range(40):
        base = " ".join(words(rnd, rnd.randint(3, 200)))
        for k in range(rnd.randint(1, 7)):
            rows.append((len(rows), varied(rnd, base, k)))
    passage = " ".join(words(rnd, 20))
    rows += [(len(rows) + k, f"{' '.join(words(rnd, 9))} {passage} {' '.join(words(rnd, 9))}") for k in range(30)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [4, 5])
def test_near_groups_equal_all_pairs(spark, families, n):
    want = edges.near_groups(families, n)
    got = near_components(edges.frame(spark, families), Near(words=n)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(edges.shingles(t, n)) for d, t in families}


def test_chain_of_near_copies_and_wide_bands(spark):
    """Neighbours of a chain are linked, its ends aren't; bands of one register put all into the same buckets."""
    w = [f"c{i}" for i in range(130)]
    rows = [(i, " ".join(w[i * 3 : i * 3 + 40])) for i in range(30)]
    want = edges.near_groups(rows, 4)
    assert set(want.values()) == {0}
    for band in (6, 1):
        assert {r.doc_id: r.component_id for r in near_components(edges.frame(spark, rows), Near(band=band)).collect()} == want


def test_near_edges(spark):
    got = {}
    for r in near_components(edges.frame(spark)).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert sorted(got[None]) == [(0, None, True), (57, None, True)]
    assert got[1] == got[2][:0] + [(0, 1, True)] and got[3] == [(0, 3, True)]
    assert got[5] == [(57, 4, False)] and got[6] == [(57, 4, False)] * 2
    assert got[7] == [(1, 7, True)] and got[8] == [(1, 7, False)]
    assert near_components(edges.frame(spark, [])).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    up = {}
    for a, b in pairs:
        if a is not None and a != b:
            for x in (a, b):
                up.setdefault(x, {x})
            both = up[a] | up[b]
            for x in both:
                up[x] = both
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: min(s) for x, s in up.items()}


@pytest.mark.parametrize("chunk_bytes, cells_each", [(1 << 20, 1 << 20), (700, 300)])
def test_windows_equal_brute_force(spark, families, chunk_bytes, cells_each):
    rows = families + [(1000 + d if d is not None else None, t) for d, t in edges.ROWS]
    got = remove_repeated_windows(edges.frame(spark, rows), 13, chunk_bytes=chunk_bytes, cells_each=cells_each).collect()
    key = lambda r: (r[0] is None, *[x or 0 for x in r[:3]], r[3])
    assert sorted((tuple(r) for r in got), key=key) == sorted(edges.window_dedup(rows, 13), key=key)


def test_windows_text_and_empty(spark):
    rows = [(1, "a b c d e"), (2, "x a  b c y"), (-5, "c d e")]
    got = {r.doc_id: r.kept_text for r in remove_repeated_windows(edges.frame(spark, rows), 3, with_text=True).collect()}
    assert got == {-5: "c d e", 1: "a b", 2: "x y"}
    assert remove_repeated_windows(edges.frame(spark, [])).count() == 0


def test_lines_equal_brute_force(spark):
    rnd = random.Random(6)
    lines = ["a", "b", "c", "", " ", "l" * 45, "é" * 19, "é" * 20, "日" * 13, "日" * 14, "ж" * 30]
    rows = [(i, "\n".join(rnd.choice([*lines, f"u{rnd.randrange(40)}"]) for _ in range(rnd.randint(0, 25)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200, None)]
    for least in (40, 0):
        got = {r.doc_id: (r.text or "", r.n_lines, r.n_removed) for r in without_later_copies(edges.frame(spark, rows), least).collect()}
        assert got == edges.line_dedup(rows, least)


def test_repeated_line_in_a_script_without_spaces(spark):
    line, heading = "本网站的所有内容均受版权保护，未经书面许可，不得以任何形式转载或者复制。", "目录与说明"
    assert len(line) < 40
    rows = [(i, f"u{i}\n{line}\nv{i}\n{heading}\nshort heading") for i in range(2)] + [(2, f"x\n{heading}\ny"), (3, "p\nshort heading\nq")]
    got = {r.doc_id: r.text for r in without_later_copies(edges.frame(spark, rows)).collect()}
    assert got[0] == rows[0][1] and got[1] == "u1\nv1" and got[2] == rows[2][1] and got[3] == rows[3][1]


def test_line_edges(spark):
    out = without_later_copies(edges.frame(spark))
    assert out.columns == [*edges.frame(spark, []).columns[:11], "n_lines", "n_removed", "n_runs"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_removed))
    assert (None, 0) in got[None] and (edges.BASE, 0) in got[None]
    assert got[1] == [(None, 0)] and got[3] == [(" \n\t \n", 0)] and got[4] == [(edges.BASE, 0)] and got[5] == [("", 1)]
    assert got[6] == [(edges.BASE.replace("w30", "x"), 0)] * 2
    assert got[9] == [("short line", 4)]
    assert without_later_copies(edges.frame(spark, [])).count() == 0


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(9)
    items = [(i, " ".join(words(rnd, rnd.randint(2, 40), 500))) for i in range(30)] + [(90, None), (91, ""), (92, "?!"), (None, "w1 w2 w3 w4 w5 w6")]
    texts = []
    for i in range(120):
        item = items[i % 30][1]
        texts.append((i, f"{' '.join(words(rnd, rnd.randint(0, 30)))} {varied(rnd, item, i % 4).upper().replace(' ', ', ')}. {' '.join(words(rnd, rnd.randint(0, 30)))}"))
    want = {}
    for d, t in texts:
        w = [x.strip(".,").lower() for x in t.split()]
        for i, item in items[:30]:
            v = item.split(" ")
            k = min(5, len(v))
            grams = lambda x: [tuple(x[j : j + k]) for j in range(len(x) - k + 1)]
            best = 0.0
            for p in range(len(w) - len(v) + 1):
                left, shared = grams(v), 0
                for g in grams(w[p : p + len(v)]):
                    if g in left:
                        left.remove(g)
                        shared += 1
                best = max(best, shared / (2 * len(grams(v)) - shared))
            if best >= 0.8:
                want[d, i] = best
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, similarity int")
    for leak in (Leak(), Leak(slice_items=16)):
        got = {(r.doc_id, r.item_id): r.similarity for r in leaks(edges.frame(spark, texts), bench, leak).collect()}
        assert got == pytest.approx(want)
    assert leaks(edges.frame(spark), bench).count() == 0
    assert leaks(edges.frame(spark, []), bench).count() == 0 and leaks(edges.frame(spark, texts), bench.limit(0)).count() == 0


def test_leaks_of_texts_shorter_than_the_item(spark):
    """Texts cut off from items: each is compared as one window; copies and repeated words too."""
    rnd = random.Random(10)
    items = [(i, " ".join(words(rnd, n, 500))) for i, n in enumerate([*range(1, 31), 50, 60, 120, 9, 9])] + [(80, "a " * 30 + "b c d e f g")]
    texts = []
    for _, item in items:
        w = item.split()
        for cut in range(1, len(w) // 4 + 2):
            texts += [(0, " ".join(w[: len(w) - cut])), (0, ", ".join(w[cut:]).upper()), (0, varied(rnd, " ".join(w[cut:]), 1))]
    texts = [(d, t) for d, (_, t) in enumerate(texts)]
    want = {}
    for d, t in texts:
        w = t.lower().replace(",", "").split()
        for i, item in items:
            v = item.split()
            k, best = min(5, len(v)), 0.0
            grams = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            for p in range(max(1, len(w) - len(v) + 1)):
                a, b = grams(w[p : p + len(v)]), grams(v)
                shared = (a & b).total()
                best = max(best, shared / (a.total() + b.total() - shared))
            if best >= 0.8:
                want[d, i] = best, min(len(w), len(v))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert sum(len(texts[d][1].split()) < len(dict(items)[i].split()) for d, i in want) > 60
    for leak in (Leak(), Leak(slice_items=16)):
        got = {(r.doc_id, r.item_id): (r.similarity, r.n_words) for r in leaks(edges.frame(spark, texts), bench, leak).collect()}
        assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
    assert {r.start_word for r in leaks(edges.frame(spark, [(1, " ".join(items[30][1].split()[:49]))]), bench).collect()} == {0}


def test_pipeline_against_brute_force(spark, tmp_path):
    rnd = random.Random(12)
    items = [(i, " ".join(words(rnd, 25))) for i in range(5)]
    line = "this line of more than forty characters stands in many documents"
    rows = [(i, "\n".join(" ".join(words(rnd, 12)) for _ in range(rnd.randint(3, 8)))) for i in range(40)]
    rows += [(40 + i, f"{line}\n{t}") for i, (_, t) in enumerate(rows[:5])]  # copies but for a line
    rows += [(50 + i, varied(rnd, t, 1)) for i, (_, t) in enumerate(rows[5:10])]  # near copies
    rows += [(60 + i, f"{' '.join(words(rnd, 30))} {t} {' '.join(words(rnd, 30))}") for i, (_, t) in enumerate(items)]
    rows += [(70, "junk " * 50), (71, "few words"), (72, None)]
    sf = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    left = {d: t for d, t in rows if d < 70}
    left = {d: t for d, (t, n, gone) in edges.line_dedup(left.items()).items() if gone < n or not gone}
    groups = edges.near_groups(left.items(), 5)
    left = {d: t for d, t in left.items() if groups[d] == d and d not in range(60, 65)}
    assert len(left) < 60
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(left) and set(range(40)) <= set(got)


def test_pipeline_stages_on_edges(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, n int"
    for rows in (edges.ROWS, []):
        docs = spark.createDataFrame([(d, t, None, None, None, 1, 2) for d, t in rows], schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= len(rows)
            assert name == "bpe_encoding" or out.columns == corpus_pipeline.COLUMNS


def test_pairs_asked_of_the_index():
    """2,000 items of 30 words: only pairs that share a shingle are compared, in bounded memory."""
    import numpy as np

    from tidemark.llm.decontaminate import Bench

    rnd = random.Random(12)
    items = [" ".join(words(rnd, 30, 20_000)) for _ in range(2000)]
    texts = [" ".join(words(rnd, 3000, 20_000) + items[k].split(" ") + words(rnd, 40, 20_000)) for k in range(0, 60, 4)]
    bench = Bench(list(range(2000)), items, Leak())
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    found = bench.matches(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert [(row, item) for row, item, *_ in found] == [(k, 4 * k) for k in range(15)] and all(f[2] == 1 for f in found)
    sharing = 0
    for text in texts:
        w = text.split(" ")
        sets = [{tuple(w[j : j + 5]) for j in range(i, i + 26)} for i in range(len(w) - 29)]
        for item in items[: 60 : 4]:
            v = item.split(" ")
            own = {tuple(v[j : j + 5]) for j in range(26)}
            sharing += sum(not own.isdisjoint(s) for s in sets)
    assert sharing <= bench.compared <= sharing + 50


def test_slices_one_after_the_other(spark):
    rnd = random.Random(13)
    items = [(k, " ".join(words(rnd, 20))) for k in range(9)]
    rows = [(k, " ".join(words(rnd, 15) + items[k % 9][1].split(" ") + words(rnd, 5))) for k in range(30)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = leaks(edges.frame(spark, rows), bench, Leak(slice_items=4))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(k, k % 9) for k in range(30)]

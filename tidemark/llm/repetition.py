"""Quality rules by repetition coverage (operator 6).

For several n-gram lengths, rolling hashes over the words of a text find the
n-grams that occur again; the share of the characters inside them, and inside
repeated lines, decides. Everything runs on flat arrays of many texts at once,
one pass over each batch and no shuffle.

Null and empty texts have no words: counts are 0 and the base rule rejects
them. Repeated rows get a row each. Null ``doc_id`` is passed through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.flat import SPACE, U64, Words, blocks, covered, over_texts, per_row, repeated, row_sums, run_hashes, runs, _BYTE

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, dup_line_share double, top_gram_share double, dup_gram_share double, reason string"
)
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Limits:
    """Largest accepted shares of a text's word characters.

    ``dup``: inside n-grams found twice or more, by n. ``top``: inside the
    most frequent n-gram when it is found ``top_times`` or more, by n.
    ``lines``: inside lines equal to an earlier one.
    """

    min_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    dup: dict[int, float] = field(default_factory=lambda: {5: 0.42, 6: 0.40, 8: 0.38, 10: 0.35})
    top: dict[int, float] = field(default_factory=lambda: {2: 0.25, 3: 0.20, 4: 0.16})
    top_times: int = 4
    lines: float = 0.40


def _line_repeats(data: np.ndarray, offsets: np.ndarray, has_word: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines with a word equal to an earlier line of the row, and the characters of words in them."""
    inside = data != 10
    starts, ends, rows = runs(inside, offsets)
    values = _BYTE[2][data]
    values[~inside] = 0
    words_before = np.concatenate(([0], np.cumsum(has_word, dtype=np.int64)))
    real = words_before[ends] > words_before[starts]
    keys = per_row(run_hashes(values, starts, ends, 2), rows)[real]
    starts, ends, rows = starts[real], ends[real], rows[real]
    order = np.argsort(keys, kind="stable")
    later = order[1:][keys[order[1:]] == keys[order[:-1]]]
    n = len(offsets) - 1
    return np.bincount(rows[later], minlength=n), np.bincount(rows[later], weights=letters[ends[later]] - letters[starts[later]], minlength=n)


def _coverage(words: Words, chars: np.ndarray, n: int, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Characters inside the n-grams found twice or more in their row."""
    inside = covered(at[repeated(keys)], n, len(words))
    return np.bincount(words.rows[inside], weights=chars[inside], minlength=words.n_rows)


def _top(words: Words, chars: np.ndarray, n: int, keys: np.ndarray, at: np.ndarray, times: int) -> np.ndarray:
    """Characters (times x length) of the n-gram that takes the most characters of its row."""
    out = np.zeros(words.n_rows)
    if not len(keys):
        return out
    order = np.argsort(keys)
    cut = np.flatnonzero(np.concatenate(([True], keys[order[1:]] != keys[order[:-1]])))
    count = np.diff(np.append(cut, len(order)))
    often = count >= times
    first = at[order[cut[often]]]
    before = np.concatenate(([0], np.cumsum(chars)))
    np.maximum.at(out, words.rows[first], count[often] * (before[first + n] - before[first]))
    return out


def measure(data: np.ndarray, offsets: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """All measures and decisions of a block of texts."""
    words = Words(data, offsets)
    inside = ~SPACE[data]
    lead = (data & 0xC0) != 0x80
    letters = np.concatenate(([0], np.cumsum(lead & inside, dtype=np.int64)))
    word_chars = letters[offsets[1:]] - letters[offsets[:-1]]
    chars = letters[words.ends] - letters[words.starts]
    n_words = words.counts
    dup_lines, dup_line_chars = _line_repeats(data, offsets, inside, letters)

    keys = {}
    for n in {limits.window, *limits.dup, *limits.top}:
        at, h = words.windows(n)
        keys[n] = per_row(h, words.rows[at]), at
    k, at = keys[limits.window]
    again = covered(at[repeated(k)], limits.window, len(words))
    n_repeat = np.bincount(words.rows[again], minlength=words.n_rows)

    some = np.maximum(word_chars, 1)
    dup = {n: _coverage(words, chars, n, *keys[n]) / some for n in limits.dup}
    top = {n: _top(words, chars, n, *keys[n], limits.top_times) / some for n in limits.top}
    line_share = dup_line_chars / some
    short = n_words < limits.min_words
    base_repeat = 100 * n_repeat > limits.repeat_percent * n_words
    reason = np.full(words.n_rows, "", object)
    for name, hit in (
        ("lines", line_share > limits.lines),
        *((f"top_{n}", top[n] > most) for n, most in limits.top.items()),
        *((f"dup_{n}", dup[n] > most) for n, most in limits.dup.items()),
        ("repeat", base_repeat),
        ("short", short),
    ):
        reason[hit] = name  # the base rules come last and so name the reason
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": row_sums(SYMBOL[data], offsets), "n_dup_lines": dup_lines,
        "n_repeat_words": n_repeat, "base_failed": short | base_repeat, "kept": reason == "", "dup_line_share": line_share,
        "top_gram_share": np.max(list(top.values()), axis=0) if top else np.zeros(words.n_rows),
        "dup_gram_share": np.max(list(dup.values()), axis=0) if dup else np.zeros(words.n_rows), "reason": reason,
    }


def quality_rules(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Measures and verdict per row of ``docs`` (``doc_id``, ``text``)."""
    limits = limits or Limits()
    types = {"base_failed": pa.bool_(), "kept": pa.bool_(), "dup_line_share": pa.float64(), "top_gram_share": pa.float64(), "dup_gram_share": pa.float64(), "reason": pa.string()}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [measure(data, offsets, limits) for _, _, data, offsets in blocks(batch.column("text"))]
        columns = {"doc_id": batch.column("doc_id").cast(pa.int64())}
        for name in parts[0]:
            columns[name] = pa.array(np.concatenate([p[name] for p in parts]), types.get(name, pa.int64()))
        return pa.RecordBatch.from_pydict(columns)

    return over_texts(docs, SCHEMA, work)


def accepted(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs`` (any columns, one of them ``text``) that the rules keep; nothing is shuffled."""
    limits = limits or Limits()

    def run(batches):
        for batch in batches:
            kept = [measure(data, offsets, limits)["kept"] for _, _, data, offsets in blocks(batch.column("text"))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Byte-pair encoding by backtracking over longest matches, decoding by an offset table (operator 3).

A word is encoded in linear time: an Aho-Corasick automaton over the whole
vocabulary finds the longest token at every place; the encoder takes it if it
fits the token before (no merge across the border would have come first), else
the next shorter token, and steps back where none fits. The result is exactly
what replaying the merges gives. Each worker encodes a word once while it
remembers it, and puts texts together by gathering from flat tables.

Null and empty texts give no tokens and decode to the empty text. Repeated
rows get a row each.
"""

from __future__ import annotations

import hashlib
import unicodedata
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.flat import U64, over_texts
from tidemark.llm.pieces import NUMBER, OTHER, SPACE, Merges, OffsetTable, Points, gather, point_blocks

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
REMEMBER = 1_000_000
BLOCK = 1 << 18  # bytes of text at once; a worker's largest arrays follow it


def normal(text: str, whole: bool) -> str | None:
    """Compose and lower-case; None if a block of texts must be taken text by text. White space only parts words."""
    if not unicodedata.is_normalized("NFC", text):
        if whole:
            return None
        text = unicodedata.normalize("NFC", text)
    if whole and "İ" in text:  # the only letter that grows
        return None
    return text.replace("Σ", "σ").lower()


def words(points: Points) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of contractions, letter runs, single digits and runs of other characters."""
    kind, n = points.kind, len(points.cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n + 1, bool)
    new[points.cuts] = True
    new = new[:n]
    new[1:] |= kind[1:] != kind[:-1]
    new |= kind == NUMBER
    short = points.contractions(new & (kind == OTHER))
    for letters in (1, 2):
        at = np.flatnonzero(short == letters)
        new[at + 1] = False
        after = at + letters + 1
        new[after[after < n]] = True
    at = np.flatnonzero(new)
    ends = np.append(at[1:], n)
    real = kind[at] != SPACE
    return at[real], ends[real]


class Encoder:
    """Tables of a tokenizer file and the backtracking encoder; built on the driver, used in tasks."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.shorter = {}
        for spelled, i in self.merges.ids.items():
            self.shorter[i] = next((self.merges.ids[spelled[:k]] for k in range(len(spelled) - 1, 0, -1) if spelled[:k] in self.merges.ids), -1)
        self.size = max(self.merges.names) + 1
        self._start()

    def _start(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for spelled, i in self.merges.ids.items():
            self.automaton.add_word(spelled, i)
        self.automaton.make_automaton()
        names = [self.merges.names.get(i, "") for i in range(self.size)]
        self.shown = OffsetTable([f"{s} ".encode() for s in names])
        self.numbers = OffsetTable([f"{i} ".encode() for i in range(self.size)])
        self._forget()

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("merges", "shorter", "size")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._start()

    def encode_word(self, word: str) -> list[int]:
        text = self.merges.symbols(word)
        n, spell, fits, shorter = len(text), self.merges.spell, self.merges.fits, self.shorter
        longest = [-1] * (n + 1)
        size = [0] * n
        for end, i in self.automaton.iter(text):
            k = len(spell[i])
            if k > size[end + 1 - k]:
                size[end + 1 - k], longest[end + 1 - k] = k, i
        out: list[int] = []
        open_ends = bytearray(b"\1" * (n + 1))  # places not yet found to lead nowhere
        at, token = 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + len(spell[token])
                if open_ends[end] and (last < 0 or fits(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                open_ends[at] = 0
                out.pop()
                at -= len(spell[last])
                token = last
                break
        return out

    def _forget(self) -> None:
        self.keys, self.flat = np.zeros(0, U64), np.array(list(self.merges.specials.values()), np.int32)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = [self.encode_word(w) for w in words]
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        begin = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.count = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.count, at, count)

    def tokens(self, points: Points) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts of a block; for each word its text and the number of its ids."""
        starts, ends = words(points)
        rows = points.rows[np.searchsorted(points.cuts[1:], starts, "right")]
        inside = points.kind != SPACE
        keys, first, inverse = np.unique(points.hashes(starts, ends, inside), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBER:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        known = at < len(self.keys)
        new[known] = self.keys[at[known]] != keys[known]
        if new.any():
            self._learn(keys[new], [points.text(starts[f], ends[f]) for f in first[new].tolist()])
            at = np.searchsorted(self.keys, keys)
        begin, count = self.begin[at][inverse], self.count[at][inverse].astype(np.int64)
        if points.marks:
            names = {name: k for k, name in enumerate(self.merges.specials)}  # the first ids in ``flat``
            where = np.concatenate((starts, [p - 0.5 for p, _, _ in points.marks]))
            order = np.lexsort((where, np.concatenate((rows, [r for _, r, _ in points.marks]))))
            begin = np.concatenate((begin, [names[s] for _, _, s in points.marks]))[order]
            count = np.concatenate((count, np.ones(len(points.marks), np.int64)))[order]
            rows = np.concatenate((rows, [r for _, r, _ in points.marks]))[order]
        ids, _ = gather(self.flat, begin, count)
        return ids, rows, count

    def decode(self, ids: np.ndarray) -> str:
        data, _ = self.shown.gather(ids)
        return data[:-1].tobytes().decode("utf-8")


def _digests(table: OffsetTable, ids: np.ndarray, upto: np.ndarray) -> list[str]:
    """Hex digests of the joined entries of each row; ``upto``: ids up to each row's end."""
    data, ends = table.gather(ids)
    view = memoryview(np.ascontiguousarray(data))
    at = np.concatenate(([0], ends))[np.concatenate(([0], upto))].tolist()
    return [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Count and digests of the ids of each text and of what they decode to, per row of ``docs`` (``doc_id``, ``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(path))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, n, told, back = shared.value, [], [], []
        for lo, hi, points in point_blocks(batch.column("text"), tuple(encoder.merges.specials), normal, BLOCK):
            ids, rows, count = encoder.tokens(points)
            each = np.bincount(rows, weights=count, minlength=hi - lo).astype(np.int64)
            upto = np.cumsum(each)
            n.append(each)
            told += _digests(encoder.numbers, ids, upto)
            back += _digests(encoder.shown, ids, upto)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_tokens": pa.array(np.concatenate(n), pa.int64()),
                "ids_sha256": pa.array(told, pa.string()),
                "decoded_sha256": pa.array(back, pa.string()),
            }
        )

    return over_texts(docs, SCHEMA, work)

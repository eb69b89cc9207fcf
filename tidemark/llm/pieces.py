"""Code points of many texts at once, the merge tables of a public tokenizer, and gathering by offset tables."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa

from tidemark.llm.flat import U64, blocks, run_hashes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# The Unicode White_Space characters.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point; built once in a worker."""
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE] = SPACE
        _classes.append(table)
    return _classes[0]


class Points:
    """Code points of consecutive texts; ``cuts`` are the places no piece goes over, ``rows`` the text of each stretch between them.

    ``marks``: (place, text, special string) of special strings, which are taken out of the code points.
    """

    def __init__(self, string: str, cuts: np.ndarray, rows: np.ndarray, marks: list[tuple[int, int, str]]):
        self.cp = np.frombuffer(string.encode("utf-32-le"), np.uint32)
        self.cuts, self.rows, self.marks = cuts, rows, marks
        self.kind = classes()[self.cp]

    def shifted(self, k: int) -> np.ndarray:
        """Code point ``k`` places on, 0 beyond the end of a stretch."""
        out = np.zeros(len(self.cp), np.uint32)
        if k < len(self.cp):
            out[:-k] = self.cp[k:]
        ends = self.cuts[1:]
        for j in range(1, k + 1):
            at = ends - j
            out[at[at >= self.cuts[:-1]]] = 0
        return out

    def contractions(self, first: np.ndarray) -> np.ndarray:
        """For apostrophes: letters of the contraction behind ('s 't 'm 'd: 1, 're 've 'll: 2), else 0."""
        out = np.zeros(len(self.cp), np.uint8)
        a, b = self.shifted(1), self.shifted(2)
        at = self.cp == 39
        out[at & np.isin(a, [ord(c) for c in "stmd"])] = 1
        e, ll = ord("e"), ord("l")
        out[at & ((((a == ord("r")) | (a == ord("v"))) & (b == e)) | ((a == ll) & (b == ll)))] = 2
        return out * first

    def hashes(self, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        values = self.cp.astype(U64) + U64(1)
        if inside is not None:
            values[~inside] = 0
        return run_hashes(values, starts, ends, 3)

    def text(self, start: int, end: int) -> str:
        return self.cp[start:end].tobytes().decode("utf-32-le")

    def encoded(self, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of stretches."""
        parts, upto = gather(self.cp, starts, ends - starts)
        size = 1 + (parts >= 0x80) + (parts >= 0x800) + (parts >= 0x10000)
        at = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], upto))].tolist()
        raw = parts.tobytes().decode("utf-32-le").encode("utf-8")
        return [raw[a:b] for a, b in zip(at, at[1:])]


def point_blocks(texts: pa.Array, specials: tuple[str, ...], normal=None, size: int = 1 << 20):
    """(first row, end row, Points) of blocks of whole texts.

    ``normal(block) -> str or None`` normalises a whole block if that keeps
    the length of every text, and any single text.
    """
    for lo, hi, data, offsets in blocks(texts, size):
        string = data.tobytes().decode("utf-8")
        whole = string if normal is None else normal(string, True)
        if whole is not None and not any(s in string for s in specials):
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            yield lo, hi, Points(whole, points[offsets], np.arange(hi - lo), [])
            continue
        parts, cuts, rows, marks, at = [], [0], [], [], 0
        raw = data.tobytes()
        for row in range(hi - lo):
            text = raw[offsets[row] : offsets[row + 1]].decode("utf-8")
            for part, special in _split(text, specials):
                if special:
                    marks.append((at, row, part))
                    continue
                part = part if normal is None else normal(part, False)
                parts.append(part)
                at += len(part)
                cuts.append(at)
                rows.append(row)
        yield lo, hi, Points("".join(parts), np.array(cuts), np.array(rows, np.int64), marks)


def _split(text: str, specials: tuple[str, ...]):
    """Parts of a text in order, and whether each is a special string; of each string its next place is remembered."""
    at, places = 0, {s: text.find(s) for s in specials}
    while found := min(((k, s) for s, k in places.items() if k >= 0), default=None):
        if found[0] > at:
            yield text[at : found[0]], False
        yield found[1], True
        at = found[0] + len(found[1])
        places |= {s: text.find(s, at) for s, k in places.items() if 0 <= k < at}
    if at < len(text):
        yield text[at:], False


class Merges:
    """Tables of a byte-pair tokenizer file, over its own symbols.

    ``spell[id]`` spells a token in base symbols (one character each; with an
    end-of-word suffix the last one is another character), ``ids`` is the
    reverse. ``pairs`` maps two ids to the token they merge into, ``halves`` back.
    Ids rise with the order of merges, on which ``fits`` relies.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.suffix = bool(suffix)
        self.names = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in told["added_tokens"]}
        self.specials = {t["content"]: t["id"] for t in told["added_tokens"]}
        order = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in order} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in order)}
        self.base = {shown[b]: chr(b) for b in range(256)}
        self.spell, self.pairs, self.halves = {}, {}, {}
        for s, c in self.base.items():
            self.spell[vocab[s]] = c
            if suffix:
                self.spell[vocab[s + suffix]] = chr(ord(c) + 256)
        last = max(self.spell)
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            i, a, b = vocab[left + right], vocab[left], vocab[right]
            if i != last + 1:
                raise ValueError("token ids don't follow the order of merges")
            last = i
            self.spell[i] = self.spell[a] + self.spell[b]
            self.pairs[a, b], self.halves[i] = i, (a, b)
        self.ids = {s: i for i, s in self.spell.items()}
        self.longest = max(map(len, self.ids))
        self.known: dict[int, bool] = {}

    def symbols(self, piece: str) -> str:
        """A piece of text in base symbols."""
        s = piece.encode("utf-8").decode("latin-1")
        return s[:-1] + chr(ord(s[-1]) + 256) if self.suffix else s

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b can stand side by side: no merge across their border would have come first."""
        hit = self.known.get(a << 32 | b)
        if hit is None:
            if len(self.known) > 100_000:
                self.known.clear()
            hit = self.known[a << 32 | b] = self._fits(a, b)
        return hit

    def _fits(self, a: int, b: int) -> bool:
        bound = 1 << 60  # a merge across the border counts if it comes before the one that hid it
        while True:
            if self.pairs.get((a, b), bound) < bound:
                return False
            if a > b:  # the younger token is taken apart
                bound = a
                if a not in self.halves:
                    return True
                a = self.halves[a][1]
            else:
                bound = b + 1
                if b not in self.halves:
                    return True
                b = self.halves[b][0]


class OffsetTable:
    """Strings of numbered entries in one byte array, gathered for many numbers at once."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all entries one after the other, and the end of each."""
        return gather(self.data, self.starts[numbers], self.lengths[numbers])


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    if not len(ends):
        return data[:0], ends
    return data[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)], ends

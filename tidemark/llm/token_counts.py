"""Token counts by finite-state transducers (operator 10).

Two deterministic transducers count tokens without listing them:

* One reads classes of code points and emits 1 where a word of the tokenizer
  starts. A text is cut into chunks. Each chunk gives a state map: for every
  entry state the exit state and the number emitted. Maps compose
  associatively, so a parallel prefix scan over the chunks of all texts of a
  batch gives each chunk its entry state, and a second pass its word starts.
* The other reads a word's bytes. Its state holds the vocabulary prefixes open
  at a place, each with the last token and the count where it began; a
  transition is annotated with the tokens it emits (negative where a merge joins
  tokens), as one of the open prefixes ends in the last token of what is read.
  Prefixes are the states of a compiled trie, so a state is bounded by the
  longest token and states that behave alike are one. The new words of a block
  take each step together in numpy. Words of more than ``WIDE`` bytes go through
  numbered states whose transitions are kept once met, within a bound.

Null and empty texts have no tokens. Repeated rows get a row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.flat import U64, mix, over_texts, raw
from tidemark.llm.pieces import SPACE, Merges, Points, point_blocks

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_words bigint"
CHUNK = 256
WORDS_KEPT = 1_000_000
STATES_KEPT = 200_000
WIDE = 64

# Symbols: the class of a code point and what follows it.
PAD, LET, NUM, OTH, BLANK_LAST, WHITE_LAST, WHITE_MORE, APOS_1, APOS_2 = range(9)
# States: what the next symbol may join.
FRESH, IN_WHITE, BLANK, IN_LET, IN_NUM, IN_OTH, SHORT_1, SHORT_2 = range(8)


def word_starts() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 if a word starts) by symbol and state."""
    opens = {LET: IN_LET, NUM: IN_NUM, OTH: IN_OTH, BLANK_LAST: BLANK, WHITE_LAST: FRESH, WHITE_MORE: IN_WHITE, APOS_1: SHORT_1, APOS_2: SHORT_2}
    joins = {
        (IN_LET, LET): IN_LET, (IN_NUM, NUM): IN_NUM, (IN_OTH, OTH): IN_OTH, (IN_OTH, APOS_1): IN_OTH, (IN_OTH, APOS_2): IN_OTH,
        (IN_WHITE, WHITE_MORE): IN_WHITE, (BLANK, LET): IN_LET, (BLANK, NUM): IN_NUM, (BLANK, OTH): IN_OTH, (BLANK, APOS_1): IN_OTH,
        (BLANK, APOS_2): IN_OTH, (SHORT_1, LET): FRESH, (SHORT_2, LET): SHORT_1,
    }
    to, emits = np.zeros((9, 8), np.uint8), np.zeros((9, 8), np.uint8)
    to[PAD] = np.arange(8)
    for symbol, state in opens.items():
        to[symbol], emits[symbol] = state, 1
    for (before, symbol), state in joins.items():
        to[symbol, before], emits[symbol, before] = state, 0
    return to, emits


TO, EMITS = word_starts()


def symbols(points: Points) -> np.ndarray:
    """Symbol of every code point, by class and the next code points."""
    kind = points.kind
    out = np.array([WHITE_MORE, LET, NUM, OTH], np.uint8)[kind]
    last = np.zeros(len(kind), bool)
    last[:-1] = kind[1:] != SPACE
    ends = points.cuts[1:][np.diff(points.cuts) > 0]
    last[ends - 1] = False
    out[(kind == SPACE) & last] = WHITE_LAST
    out[(points.cp == 32) & last] = BLANK_LAST
    short = points.contractions(np.ones(len(kind), np.uint8))
    out[short == 1], out[short == 2] = APOS_1, APOS_2
    return out


def starts_of_words(points: Points) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the code points at which words start, and the number of words of each stretch."""
    lengths = np.diff(points.cuts)
    chunks = -(-lengths // CHUNK)
    n = int(chunks.sum())
    mask = np.zeros(len(points.cp), bool)
    if not n:
        return mask, np.zeros(len(lengths), np.int64)
    owner = np.repeat(np.arange(len(lengths)), chunks)
    first = np.concatenate(([0], np.cumsum(chunks)))[:-1]
    number = np.arange(n) - first[owner]
    begin = points.cuts[:-1][owner] + number * CHUNK
    size = np.minimum(CHUNK, points.cuts[1:][owner] - begin)
    grid = np.zeros((CHUNK, n), np.uint8)
    code = np.append(symbols(points), np.uint8(PAD))
    for j in range(CHUNK):
        grid[j] = code[np.where(j < size, begin + j, len(code) - 1)]

    state = np.repeat(np.arange(8, dtype=np.uint8)[:, None], n, axis=1)  # the map of each chunk
    emitted = np.zeros((8, n), np.int64)
    to, emits = TO.reshape(-1), EMITS.reshape(-1)
    for j in range(CHUNK):
        step = grid[j] * np.uint8(8) + state
        emitted += emits[step]
        state = to[step]
    step = 1
    while step < chunks.max():  # prefix scan: a map after the maps before it, in spans that double
        later = np.flatnonzero(number >= step)
        before = later - step
        via = state[:, before]
        emitted_next = emitted[:, before] + np.take_along_axis(emitted[:, later], via.astype(np.int64), 0)
        state_next = np.take_along_axis(state[:, later], via.astype(np.int64), 0)
        emitted[:, later], state[:, later] = emitted_next, state_next
        step *= 2
    entry = np.full(n, FRESH, np.uint8)
    inner = np.flatnonzero(number > 0)
    entry[inner] = state[FRESH, inner - 1]
    for j in range(CHUNK):
        step = grid[j] * np.uint8(8) + entry
        at = np.flatnonzero(emits[step])
        mask[begin[at] + j] = True
        entry = to[step]
    total = np.zeros(len(lengths), np.int64)
    some = chunks > 0
    total[some] = emitted[FRESH, (first + chunks - 1)[some]]
    return mask, total


class PairTable:
    """Whether two tokens can stand side by side, for many pairs at once; recent answers are kept in a table of fixed size."""

    BITS = 20

    def __init__(self, merges: Merges):
        n = max(merges.spell) + 1
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for i, (a, b) in merges.halves.items():
            self.left[i], self.right[i] = a, b
        order = sorted((a << 32 | b, i) for (a, b), i in merges.pairs.items())
        self.keys, self.made = np.array([k for k, _ in order], np.int64), np.array([i for _, i in order], np.int64)
        self.asked, self.answer = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, bool)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As ``Merges.fits``; a negative ``a`` is the start of a word, where any token fits."""
        key = np.maximum(a, 0) << 32 | b
        slot = (mix(key.astype(U64)) >> U64(64 - self.BITS)).astype(np.int64)
        new = np.flatnonzero((self.asked[slot] != key) & (a >= 0))
        out = self.answer[slot]
        if len(new):
            out[new] = found = self._fits(a[new], b[new])
            self.asked[slot[new]], self.answer[slot[new]] = key[new], found
            clash = self.asked[slot[new]] != key[new]  # another pair took the slot: its answer must stand there
            again = slot[new[clash]]
            if len(again):
                self.asked[again] = -1
        out[a < 0] = True
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, at = np.ones(len(a), bool), np.arange(len(a))
        bound = np.full(len(a), 1 << 60)  # a merge across the border counts if it comes before the one that hid it
        while len(at):
            key = a << 32 | b
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            bad = (self.keys[place] == key) & (self.made[place] < bound)
            out[at[bad]] = False
            later = a > b  # the younger token is taken apart
            bound = np.where(later, a, b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
            on = ~bad & (a >= 0) & (b >= 0)
            at, a, b, bound = at[on], a[on], b[on], bound[on]
        return out


class WordCounter:
    """Transducer over the bytes of a word, compiled from the vocabulary; transitions carry the number of tokens they emit."""

    def __init__(self, merges: Merges):
        if merges.suffix:
            raise ValueError("words of this tokenizer have an end of their own")
        self.merges = merges
        edges: dict[int, int] = {}
        tokens = [-1]
        for spelled, i in merges.ids.items():
            at = 0
            for c in spelled:
                at = edges.setdefault(at << 8 | ord(c), len(tokens))
                if at == len(tokens):
                    tokens.append(-1)
            tokens[at] = i
        self.edges = edges
        self._start(tokens)

    def _start(self, tokens: list[int]) -> None:
        self.token = np.array(tokens, np.int64)
        order = sorted(self.edges.items())
        self.keys, self.child = np.array([k for k, _ in order], np.int64), np.array([v for _, v in order], np.int64)
        self.first = np.full(256, -1, np.int64)
        at = self.keys < 256
        self.first[self.keys[at]] = self.child[at]
        self.inner = np.zeros(len(tokens), bool)
        self.inner[self.keys >> 8] = True
        self.table = PairTable(self.merges)
        self._forget()

    def _forget(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.opened, self.moves = {start: 0}, [start], {}

    def __getstate__(self) -> dict:
        return {"merges": self.merges, "edges": self.edges, "token": self.token.tolist()}

    def __setstate__(self, state: dict) -> None:
        self.merges, self.edges = state["merges"], state["edges"]
        self._start(state["token"])

    def matches(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, token) of every vocabulary token in the words; ``left``: bytes from each place to its word's end."""
        starts, sizes, found = [], [], []
        at, node, size = np.arange(len(data)), self.first[data], 1
        while len(at):
            token = self.token[node]
            here = token >= 0
            starts.append(at[here])
            sizes.append(np.full(int(here.sum()), size))
            found.append(token[here])
            on = self.inner[node] & (left[at] > size)
            at, node = at[on], node[on]
            key = node << 8 | data[at + size]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            at, node, size = at[hit], self.child[place[hit]], size + 1
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(found)

    def count_all(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; all words take their k-th step together."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        rows = np.repeat(np.arange(len(words)), sizes)
        start, size, token = self.matches(data, ends[rows] - np.arange(len(data)))
        row = rows[start]
        step = start + size - (ends - sizes)[row]
        order = np.argsort((step << 40) | (row << 8) | (255 - size))  # longest token first
        start, size, token, row, step = (x[order] for x in (start, size, token, row, step))
        last, count = np.full(len(data) + len(words), -1), np.zeros(len(data) + len(words), np.int64)  # before each byte, and at each end
        here, there = start + row, start + size + row
        cuts = np.flatnonzero(np.diff(step, prepend=0)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(step)]):
            at = lo + np.flatnonzero(self.table.fits(last[here[lo:hi]], token[lo:hi]))
            at = at[np.diff(row[at], prepend=-1) > 0]
            last[there[at]], count[there[at]] = token[at], count[here[at]] + 1
        return count[ends + np.arange(len(words))]

    def count(self, word: bytes) -> int:
        """Tokens of a word of any length, state by state."""
        state, total, moves = 0, 0, self.moves
        for symbol in word:
            move = moves.get(state << 8 | symbol)
            if move is None:
                move = self._compile(state, symbol)
            state, emitted = move
            total += emitted
        return total

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """Transition: the longest open prefix that ends in a token which fits the last one gives the last token."""
        opened = self.opened[state]
        if len(self.opened) > STATES_KEPT:
            self._forget_but(opened)
            state = self.states[opened]
        grown = [(self.edges.get(node << 8 | symbol, -1), before, rest) for node, before, rest in opened]
        for node, before, rest in grown:
            token = int(self.token[node]) if node >= 0 else -1
            if token >= 0 and (before < 0 or self.merges.fits(before, token)):
                break
        emitted = rest + 1
        to = (*((n, b, r - emitted) for n, b, r in grown if n >= 0 and self.inner[n]), (0, token, 0))
        if (number := self.states.get(to)) is None:
            number = self.states[to] = len(self.opened)
            self.opened.append(to)
        self.moves[state << 8 | symbol] = number, emitted
        return number, emitted

    def _forget_but(self, opened: tuple) -> None:
        self.states.clear()
        self.moves.clear()
        self.opened[:] = [((0, -1, 0),), opened]
        self.states |= {s: k for k, s in enumerate(self.opened)}


class Counter:
    """Remembers the counts of words by hash in sorted arrays, within a bound."""

    def __init__(self, path: str):
        self.words = WordCounter(Merges(path))
        self._forget()

    def _forget(self) -> None:
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int32)

    def __getstate__(self) -> dict:
        return {"words": self.words}

    def __setstate__(self, state: dict) -> None:
        self.words = state["words"]
        self._forget()

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words))
        counts, short = np.zeros(len(words), np.int32), np.flatnonzero(size <= WIDE)
        if len(short):
            counts[short] = self.words.count_all([words[k] for k in short.tolist()])
        for k in np.flatnonzero(size > WIDE).tolist():
            counts[k] = self.words.count(words[k])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.counts = np.insert(self.keys, at, keys), np.insert(self.counts, at, counts)

    def block(self, points: Points, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and words of each of the ``n`` texts of a block."""
        mask, found = starts_of_words(points)
        n_words = np.bincount(points.rows, weights=found, minlength=n).astype(np.int64)
        starts = np.flatnonzero(mask)
        ends = np.append(starts[1:], len(mask))
        keys, first, inverse = np.unique(points.hashes(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > WORDS_KEPT:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            self._learn(keys[new], points.encoded(starts[first[new]], ends[first[new]]))
            at = np.searchsorted(self.keys, keys)
        rows = points.rows[np.searchsorted(points.cuts[1:], starts, "right")]
        tokens = np.bincount(rows, weights=self.counts[at][inverse], minlength=n).astype(np.int64)
        for _, row, _ in points.marks:
            tokens[row] += 1
        return tokens, n_words


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens per row of ``docs`` (``doc_id``, ``text``) for a byte-level tokenizer file."""
    shared = docs.sparkSession.sparkContext.broadcast(Counter(path))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = shared.value
        specials = tuple(counter.words.merges.specials)
        parts = [counter.block(points, hi - lo) for lo, hi, points in point_blocks(batch.column("text"), specials)]
        tokens, n_words = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_bytes": pa.array(np.diff(raw(batch.column("text"))[0]), pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()),
                "over_limit": pa.array(tokens > limit, pa.bool_()),
                "n_words": pa.array(n_words, pa.int64()),
            }
        )

    return over_texts(docs, SCHEMA, work)

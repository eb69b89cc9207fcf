"""Ids of the tokenizers library for whole texts, asking it once for each different word.

For tokenizers that drop white space: no piece and no special string of theirs
goes over a space, tab or line end, so the ids of a text are those of its
words one after the other. A worker remembers words in sorted arrays.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from tidemark.llm.flat import U64, Words, blocks
from tidemark.llm.pieces import gather

REMEMBER = 1_000_000
ASKED = 20_000


class LibraryEncoder:
    """A tokenizer file for ``tokenizers``; read on the driver, used in tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.told = f.read()
        told = json.loads(self.told)
        splits = json.dumps(told.get("pre_tokenizer"))
        if '"Removed"' not in splits or "\\\\s" not in splits:
            raise ValueError("the tokenizer does not drop white space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in told["added_tokens"]):
            raise ValueError("special strings reach over white space")
        self.size = max([*told["model"]["vocab"].values(), *(t["id"] for t in told["added_tokens"])]) + 1
        self._start()

    def _start(self) -> None:
        self.library = None
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, U64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def __getstate__(self) -> dict:
        return {"told": self.told, "size": self.size}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._start()

    def ask(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as the library gives them."""
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.told)
            self.library.no_truncation()
            self.library.no_padding()
        return [e.ids for k in range(0, len(texts), ASKED) for e in self.library.encode_batch_fast(texts[k : k + ASKED], add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = self.ask(texts)
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        begin = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.count = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.count, at, count)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and their number for each text; null is empty."""
        parts, counts = [], []
        for lo, hi, data, offsets in blocks(texts):
            words = Words(data, offsets)
            keys, first, inverse = np.unique(words.hashes[0], return_index=True, return_inverse=True)
            if len(self.keys) > REMEMBER:
                self._forget()
            at = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), bool)
            inside = at < len(self.keys)
            new[inside] = self.keys[at[inside]] != keys[inside]
            if new.any():
                raw, begin, end = data.tobytes(), words.starts[first[new]].tolist(), words.ends[first[new]].tolist()
                self._learn(keys[new], [raw[a:b].decode("utf-8") for a, b in zip(begin, end)])
                at = np.searchsorted(self.keys, keys)
            slots = at[inverse]
            size = self.count[slots].astype(np.int64)
            parts.append(gather(self.flat, self.begin[slots], size)[0])
            counts.append(np.bincount(words.rows, weights=size, minlength=hi - lo).astype(np.int64))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return join(parts, np.uint32), join(counts, np.int64)

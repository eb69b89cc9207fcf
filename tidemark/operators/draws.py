"""Random numbers that a row's id fixes: quarters of md5 digests, as SQL can compute them too.

The digests of many short messages are taken together: each step of md5 is a few
numpy operations over all messages "<k>|<id>" of a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np

ROWS, DIGESTS = 4_096, 16  # ids and numbers k of a block
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFT = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_FITS = 55  # bytes of a message that is one md5 block


def _digests(message: list[np.ndarray | int], shape: tuple[int, int]) -> np.ndarray:
    """The four words of md5 of one-block messages; ``message`` has their 16 words, a number where all are equal."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    t, u = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            at = 7 * i % 16
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        word = message[at]
        if isinstance(word, int):
            t += np.uint32((word + _ADD[i]) & 0xFFFFFFFF)
        else:
            t += word
            t += np.uint32(_ADD[i])
        np.left_shift(t, np.uint32(_SHIFT[i]), out=u)
        t >>= np.uint32(32 - _SHIFT[i])
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    return np.stack([x + np.uint32(v) for x, v in zip((a, b, c, d), _START)])


def _words(texts: np.ndarray) -> np.ndarray:
    """Rows of 64 bytes as 16 arrays of little-endian words."""
    return np.ascontiguousarray(texts.view("<u4").T)


def _block(ids: np.ndarray, ks: np.ndarray, digits: int) -> np.ndarray:
    """md5 words of "<k>|<id>", shape (4, ks, ids). All k have ``digits`` digits, all ids (rows of bytes) one length."""
    head, size = digits + 1, digits + 1 + ids.shape[1]
    rest, front = np.zeros((len(ids), 64), np.uint8), np.zeros((len(ks), 64), np.uint8)
    rest[:, head:size] = ids
    rest[:, size] = 0x80
    rest[:, 56:58] = (8 * size) & 255, (8 * size) >> 8
    front[:, :head] = np.frombuffer(b"".join(b"%d|" % k for k in ks), np.uint8).reshape(len(ks), head)
    message: list[np.ndarray | int] = []
    for r, f in zip(_words(rest), _words(front)):
        message.append((r[None, :] | f[:, None]) if f.any() else int(r[0]) if (r == r[0]).all() else r)
    return _digests(message, (len(ks), len(ids)))


def draws(ids: Sequence[str | None], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """32-bit numbers, ``words`` for each id, in blocks: (rows, word numbers, array of word numbers x rows).

    Word w of an id is the quarter w % 4 of md5 of "<w // 4>|<id>", first byte highest. A null id gets zeros.
    """
    texts = [None if i is None else i.encode() for i in ids]
    sizes = np.fromiter((-1 if t is None else len(t) for t in texts), np.int64, len(texts))
    last = -(-words // 4)
    digits = [len(str(k)) for k in range(last)]
    for size in np.unique(sizes):
        same = np.flatnonzero(sizes == size)
        for lo in range(0, len(same), ROWS):
            rows = same[lo : lo + ROWS]
            if size < 0:
                yield rows, np.arange(words), np.zeros((words, len(rows)), np.uint32)
                continue
            data = np.frombuffer(b"".join(texts[r] for r in rows), np.uint8).reshape(len(rows), size)
            for d in sorted(set(digits)):
                first, end = digits.index(d), last - digits[::-1].index(d)
                for k in range(first, end, DIGESTS):
                    ks = np.arange(k, min(end, k + DIGESTS))
                    if d + 1 + size <= _FITS:
                        got = _block(data, ks, d).byteswap()
                    else:
                        raw = b"".join(md5(b"%d|%s" % (j, texts[r])).digest() for j in ks for r in rows)
                        got = np.frombuffer(raw, ">u4").astype(np.uint32).reshape(len(ks), len(rows), 4).transpose(2, 0, 1)
                    number = (ks * 4 + np.arange(4)[:, None]).ravel()
                    got = got.reshape(-1, len(rows))
                    yield (rows, number, got) if 4 * (ks[-1] + 1) <= words else (rows, number[number < words], got[number < words])

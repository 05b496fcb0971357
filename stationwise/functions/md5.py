"""MD5 of many short texts at once, in numpy: a prefix that they share, before a text each."""

from __future__ import annotations

import hashlib

import numpy as np

_ROUNDS = np.array([int(abs(np.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)], np.uint32)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORD = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes that fit one block; texts whose state stays in a core's cache.
_FITS, _CHUNK = 55, 16_384


class Texts:
    """Texts as rows of bytes, by length; ``digests(prefix)`` gives the MD5 of the prefix and each text."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.raw, lengths = raw, np.array([len(t) for t in raw], np.int64)
        self.groups = [(int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths)]
        self.bytes = [np.frombuffer(b"".join(raw[k] for k in at), np.uint8).reshape(len(at), n) for n, at in self.groups]

    def digests(self, prefix: str, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The first and last eight bytes of each digest, as numbers in their order; of texts ``first`` to ``last`` alone."""
        last = len(self.raw) if last is None else min(last, len(self.raw))
        head = np.frombuffer(prefix.encode(), np.uint8)
        high, low = np.empty(last - first, np.uint64), np.empty(last - first, np.uint64)
        for (n, at), own in zip(self.groups, self.bytes, strict=True):
            a, b = np.searchsorted(at, (first, last))
            for k in range(a, b, _CHUNK):
                some = slice(k, min(b, k + _CHUNK))
                to = at[some] - first
                if len(head) + n > _FITS:
                    both = np.frombuffer(b"".join(hashlib.md5(head.tobytes() + self.raw[i]).digest() for i in at[some]), ">u8").reshape(-1, 2)
                    high[to], low[to] = both[:, 0], both[:, 1]
                    continue
                block = np.zeros((len(to), 64), np.uint8)
                block[:, : len(head)] = head
                block[:, len(head) : len(head) + n] = own[some]
                block[:, len(head) + n] = 0x80
                block[:, 56:58] = np.frombuffer((8 * (len(head) + n)).to_bytes(2, "little"), np.uint8)
                high[to], low[to] = _one_block(block.view("<u4").T)
        return high, low


def _one_block(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # words that all texts share are numbers
    m = [np.uint32(w[0]) if (w == w[0]).all() else np.ascontiguousarray(w) for w in words]
    n = words.shape[1]
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = m[_WORD[turn](i)]
        np.add(a, f, out=a)
        if isinstance(word, np.uint32):
            np.add(a, np.uint32((int(word) + int(_ROUNDS[i])) & 0xFFFFFFFF), out=a)
        else:
            np.add(a, word, out=a), np.add(a, _ROUNDS[i], out=a)
        s = _TURNS[turn][i % 4]
        np.left_shift(a, np.uint32(s), out=t), np.right_shift(a, np.uint32(32 - s), out=a), np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    both = np.column_stack([x + np.uint32(y) for x, y in zip((a, b, c, d), _START, strict=True)])
    both = np.ascontiguousarray(both).astype("<u4", copy=False).view(">u8").astype(np.uint64)
    return both[:, 0], both[:, 1]

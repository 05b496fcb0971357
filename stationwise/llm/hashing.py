"""Hashes of words and of runs of words.

A word's hash is xxh3 of its bytes; ``word_hashes`` has cheaper ones, running sums over a text's bytes, for all its words at
once; words of more than 64 bytes, for which such sums are weak, have xxh3.  The hash of a run of words is made of those of its halves, each step through a
finisher that mixes all bits, so that no two sequences share a hash by the arithmetic alone.
"""

from __future__ import annotations

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher: every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Hashes of words, remembered while they are few."""

    def __init__(self, most: int = 1 << 17):
        import xxhash

        super().__init__()
        self.most, self._hash = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = self._hash(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each stretch of ``width`` words' hashes; none if there are fewer words."""
    n = len(words) - width + 1
    if n < 1:
        return words[:0]
    out, done, part, size = None, 0, words, 1
    while size <= width:
        if width & size:
            at = part[done : done + n]
            out, done = at if out is None else mix(mix(out + _M1) + at), done + size
        part, size = mix(mix(part[:-size] + _M1) + part[size:]) if 2 * size <= width else part, 2 * size
    return mix(out + np.uint64(width))


_PIECE, _LONG = 1 << 15, 64


def _powers(of: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(_PIECE, of, np.uint64)))


_UP, _BACK = _powers(int(_M1)), _powers(pow(int(_M1), -1, 1 << 64))


def word_edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends."""
    raw = np.frombuffer(text, np.uint8)
    gap = np.ones(len(text) + 2, bool)
    np.logical_or(raw == 32, raw - np.uint8(9) < 5, out=gap[1:-1])  # below 9 the difference is large
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, by running sums over ``_PIECE`` bytes of the text at a time."""
    import xxhash

    raw, out, i = np.frombuffer(text, np.uint8), np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _PIECE, side="right")))
        b = int(ends[j - 1])
        if b - a <= _PIECE:  # else a single word, which is hashed below
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((raw[a:b] + np.uint64(1)) * _UP[: b - a], out=sums[1:])
            at = starts[i:j] - a
            out[i:j] = (sums[ends[i:j] - a] - sums[at]) * _BACK[at]
        i = j
    for i in np.flatnonzero(ends - starts > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return mix(out)

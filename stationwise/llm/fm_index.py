"""A compressed full-text index (FM-index) of word sequences, over wavelet matrices.

What is kept of the suffix array is its Burrows-Wheeler transform and the suffixes' owners, both as wavelet matrices of
packed bits; the lengths that neighbours share, a byte each, capped at the window; and where these fall below the window,
as 32-bit places.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence, and least symbols of stretches; a packed bit vector per bit of the alphabet."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = []
        starts, at = np.zeros(symbols, np.int64), np.arange(symbols)
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (seq >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(np.uint64)
            before = np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)).astype(np.int32)
            zeros = len(seq) - int(ones.sum())
            self.levels.append((bit, packed, before, zeros))
            starts = self._down(starts, (at >> bit & 1).astype(bool), packed, before, zeros)
            seq = np.concatenate((seq[~ones], seq[ones]))
        self.starts = starts

    @staticmethod
    def _ones(i: np.ndarray, packed: np.ndarray, before: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    @classmethod
    def _down(cls, i: np.ndarray, one: np.ndarray, packed: np.ndarray, before: np.ndarray, zeros: int) -> np.ndarray:
        ones = cls._ones(i, packed, before)
        return np.where(one, zeros + ones, i - ones)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place ``i``."""
        for bit, packed, before, zeros in self.levels:
            i = self._down(i, (symbol >> bit & 1).astype(bool), packed, before, zeros)
        return i - self.starts[symbol]

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least symbol in each stretch [lo, hi), which is not empty."""
        out = np.zeros(len(lo), np.int64)
        for bit, packed, before, zeros in self.levels:
            one_lo, one_hi = self._ones(lo, packed, before), self._ones(hi, packed, before)
            one = one_hi - one_lo == hi - lo  # no zero among them
            out |= one.astype(np.int64) << bit
            lo, hi = np.where(one, zeros + one_lo, lo - one_lo), np.where(one, zeros + one_hi, hi - one_hi)
        return out

    @property
    def nbytes(self) -> int:
        return sum(packed.nbytes + before.nbytes for _, packed, before, _ in self.levels)


def suffix_order(rank: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence in which no two suffixes are equal, by prefix doubling."""
    n, step = len(rank), 1
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:]
        key = rank * (n + 2) + nxt
        order = np.argsort(key)  # only equal keys, which get one rank, may change places
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(1, key[1:] != key[:-1]))
        step *= 2
        if rank[order[-1]] == n or step >= n:
            return order


class FMIndex:
    """Index of ``texts``, lists of words, each with an ``owner`` number; every text ends with an end mark of its own."""

    def __init__(self, texts: list[list[bytes]], owners: np.ndarray, window: int):
        if not 1 < window < 256:
            raise ValueError(f"windows have 2 to 255 words, not {window}")
        self.window, m = window, len(texts)
        fresh: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        lengths = np.array([len(t) for t in texts])
        coded = np.fromiter(map(fresh.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        self.number: dict[bytes, int] = dict(fresh)
        self._own = np.split(coded, np.cumsum(lengths)[:-1])
        ends = np.cumsum(lengths + 1) - 1
        n = self.n = int(ends[-1]) + 1
        seq, is_word = np.zeros(n, np.int64), np.ones(n, bool)
        is_word[ends] = False
        seq[is_word] = coded
        order = np.where(is_word, seq + m, 0)
        order[ends] = np.arange(m)
        sa = suffix_order(order)
        symbols = len(self.number) + 1
        self.bwt = WaveletMatrix(seq[sa - 1], symbols)
        self.first = np.append(0, np.cumsum(np.bincount(seq, minlength=symbols)))
        self.owner = WaveletMatrix(np.repeat(owners, lengths + 1)[sa], int(owners.max()) + 1)
        # how many words neighbours in the suffix array share, up to the window; 0 before the first and after the last
        common, alive = np.zeros(n + 1, np.uint8), np.arange(1, n)
        padded = np.append(seq, np.zeros(window, np.int64))
        here, above = sa[1:].copy(), sa[:-1].copy()  # places in the sequence, moved on from word to word
        for k in range(window):
            a = padded[here]
            same = np.flatnonzero((a == padded[above]) & (a > 0))
            if not len(same):
                break
            alive, here, above = alive[same], here[same] + 1, above[same] + 1
            common[alive] = k + 1
        self.common = common
        self.low = np.append(common, np.zeros(-len(common) % 64, np.uint8)).reshape(-1, 64).min(1)  # in each 64
        # where the suffixes that share a window but for one word begin
        self.cuts = np.flatnonzero(common < window - 1).astype(np.int32)

    @property
    def nbytes(self) -> int:
        return self.bwt.nbytes + self.owner.nbytes + self.common.nbytes + self.low.nbytes + self.cuts.nbytes + self.first.nbytes

    def encode(self, text: list[bytes]) -> np.ndarray:
        """The numbers of a text's words; 0 for words that the index does not have."""
        return np.fromiter((self.number.get(w, 0) for w in text), np.int64, len(text))

    def own_texts(self) -> list[np.ndarray]:
        """The texts that were indexed, encoded; given once."""
        texts, self._own = self._own, []
        return texts

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes of [lo, hi) with ``symbol`` put before them."""
        return self.first[symbol] + self.bwt.rank(symbol, lo), self.first[symbol] + self.bwt.rank(symbol, hi)

    def _before(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last place up to ``i`` where neighbours share less than ``depth`` words."""
        i = i.copy()
        live = np.flatnonzero(self.common[i] >= depth)
        while len(live):
            j = i[live]
            i[live] = np.where((j & 63 == 63) & (self.low[j >> 6] >= depth[live]), j - 64, j - 1)
            live = live[self.common[i[live]] >= depth[live]]
        return i

    def _after(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place from ``i`` on where neighbours share less than ``depth`` words."""
        i = i.copy()
        live = np.flatnonzero(self.common[i] >= depth)
        while len(live):
            j = i[live]
            i[live] = np.where((j & 63 == 0) & (self.low[j >> 6] >= depth[live]), j + 64, j + 1)
            live = live[self.common[i[live]] >= depth[live]]
        return i

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger intervals of suffixes that share fewer words, and how many words."""
        depth = np.maximum(self.common[lo], self.common[hi])
        wide = np.maximum(depth, 1)
        left = np.where(depth > 0, self._before(lo, wide), 0)
        return left, np.where(depth > 0, self._after(hi, wide), self.n), depth.astype(np.int64)

    def matching(self, texts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Matching statistics of encoded texts, and the least owners of their windows.

        For each place, the length of the longest stretch from there on that the index has, up to the window; and for
        those of a whole window, the least owner of all that hold it (-1 elsewhere).  All texts are streamed at once, from
        their last word to their first: an interval takes the next word in front; where that leaves no suffix, its last
        words are let go by steps to the parent interval; of a whole window, the last word is let go first.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.append(0, np.cumsum(lengths))[:-1]
        flat = np.concatenate(texts) if len(texts) else np.zeros(0, np.int64)
        length, owner = np.zeros(len(flat), np.int64), np.full(len(flat), -1, np.int64)
        lo, hi, depth = np.zeros(len(texts), np.int64), np.full(len(texts), self.n, np.int64), np.zeros(len(texts), np.int64)
        at = begins + lengths - 1
        live = np.flatnonzero(lengths > 0)
        while len(live):
            full = live[depth[live] == self.window]
            cut = np.searchsorted(self.cuts, lo[full], side="right")
            lo[full], hi[full] = self.cuts[cut - 1], self.cuts[cut]
            depth[full] -= 1
            symbol = flat[at[live]]
            strange = live[symbol == 0]
            lo[strange], hi[strange], depth[strange] = 0, self.n, 0
            todo = live[symbol > 0]
            while len(todo):
                a, b = self.step(flat[at[todo]], lo[todo], hi[todo])
                done = a < b
                ok = todo[done]
                lo[ok], hi[ok] = a[done], b[done]
                depth[ok] += 1
                todo = todo[~done]
                lo[todo], hi[todo], depth[todo] = self.parent(lo[todo], hi[todo])
            length[at[live]] = depth[live]
            full = live[depth[live] == self.window]
            owner[at[full]] = self.owner.least(lo[full], hi[full])
            at[live] -= 1
            live = live[at[live] >= begins[live]]
        cuts = np.cumsum(lengths)[:-1]
        return np.split(length, cuts), np.split(owner, cuts)

    def count(self, text: list[bytes]) -> int:
        """How often a sequence of words occurs."""
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n, np.int64)
        for symbol in self.encode(text)[::-1]:
            if not symbol:
                return 0
            lo, hi = self.step(np.array([symbol]), lo, hi)
        return max(0, int(hi[0] - lo[0]))

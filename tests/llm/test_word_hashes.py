"""Hashes of a text's words taken at once, and the work of numbering words for an index."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np

from stationwise.llm import fm_index, gru, hashing, lm, substring


def test_words_are_those_of_the_pattern_and_hash_alike_anywhere():
    rng = random.Random(5)
    gaps, letters = [" ", "\t", "\n", "\x0b", "\x0c", "\r", " \n "], "ab\x00\x08\x0e\x1c\x1f\x85é\u2003z"
    seen: dict[bytes, int] = {}
    for n in (0, 1, 3, 50, 30_000):
        words = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(n)]
        if n == 50:
            words[7:9] = ["x" * 32_767, "y" * 32_768]
            words[30:32] = ["z" * 32_769, "z" * 100_000]
        text = rng.choice(["", " "]) + "".join(w + rng.choice(gaps) for w in words)
        raw = text.encode()
        starts, ends = hashing.word_edges(raw)
        own = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        assert own == re.findall(rb"[^\x20\x09-\x0D]+", raw) == raw.split()
        hashes = hashing.word_hashes(raw, starts, ends).tolist()
        assert len(hashes) == len(own)
        for w, h in zip(own, hashes, strict=True):
            assert seen.setdefault(w, h) == h
        whole = substring.Canonical(text)
        assert whole.joined == b" ".join(own) and whole.hashes().tolist() == hashes
        if own:
            k = len(own) // 2
            assert whole.stretches(np.array([0, k]), np.array([k + 1, len(own)])) == [b" ".join(own[: k + 1]), b" ".join(own[k:])]
    assert len(set(seen.values())) == len(seen) > 10_000


class Counted(bytes):
    asked = 0

    def __hash__(self) -> int:
        Counted.asked += 1
        return super().__hash__()


def test_indexing_and_searching_look_each_word_up_once():
    rng = random.Random(6)
    texts = [[Counted(rng.choice(b"abcdef").to_bytes() * rng.randrange(1, 4)) for _ in range(rng.randrange(0, 40))] for _ in range(60)]
    plain = [[bytes(w) for w in t] for t in texts]
    Counted.asked = 0
    index = fm_index.FMIndex(texts, np.arange(60), 5)
    own = index.own_texts()
    assert Counted.asked <= sum(map(len, texts)) + len(index.number)
    found = index.matching(own)
    again = fm_index.FMIndex(plain, np.arange(60), 5)
    for a, b in zip(found, again.matching([again.encode(t) for t in plain]), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_reading_tokens_remembers_no_words():
    rng = random.Random(7)
    texts = [" ".join(f"W{rng.randrange(10**9)}" for _ in range(400)) for _ in range(300)]
    codes = lm.Codes()
    tracemalloc.start()
    try:
        for a in range(0, 300, 20):
            found, n, hashes, tails = codes.read([*texts[a : a + 20], None])
            own = [w.encode() for t in texts[a : a + 20] for w in [*t.lower().split(), " "]] + [b" "]
            assert n.tolist() == [401] * 20 + [1] and len(found) == len(own)
            assert tails[found].tolist() == [lm.tail_of(w) for w in own]
            assert len(set(zip(own, hashes[found].tolist(), strict=True))) == len(set(own)) == len(hashes)
        del found, n, hashes, tails, own
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
    finally:
        tracemalloc.stop()


def test_training_holds_little_beside_the_model():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 500, 2_000).astype(np.uint16) for _ in range(1_000)]
    model = gru.fresh(np.ones(500), np.ones(gru.TAILS))
    tracemalloc.start()
    try:
        gru.train(model, docs, 0.01)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 85 << 20, peak

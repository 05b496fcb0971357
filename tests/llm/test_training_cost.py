"""Training takes neighbouring classes and lanes together, and what it finds does not depend on how many."""

from __future__ import annotations

import numpy as np
import pytest

from stationwise.llm import gru


def windows() -> tuple[gru.Model, tuple]:
    rng = np.random.default_rng(8)
    m = gru.fresh(np.sort(rng.integers(1, 3_000, 500))[::-1], np.arange(6.0), 8, 5)
    ids = np.minimum((rng.pareto(0.6, (5, 37)) * 5).astype(np.int64), len(m.emb) - 1)
    fresh, real = rng.random(ids.shape) < 0.1, rng.random(ids.shape) < 0.95
    return m, ((rng.random((37, 8)) - 0.5).astype(np.float32), ids, fresh, real)


def found(m: gru.Model, given: tuple) -> tuple[dict[str, np.ndarray], list[slice]]:
    word, bias, calls = np.zeros_like(m.word), np.zeros_like(m.word_bias), []

    def step(rows: slice, d_word: np.ndarray, d_bias: np.ndarray) -> None:
        calls.append(rows)
        word[rows] += d_word
        bias[rows] += d_bias

    g, (at, rows), last, loss = gru.gradients(m, *given, m.class_of, step)
    emb = np.zeros_like(m.emb)
    emb[at] = rows
    return g | {"emb": emb, "word": word, "word_bias": bias, "last": last, "loss": np.array(loss)}, calls


def test_neighbouring_classes_are_trained_at_once():
    m, given = windows()
    calls = found(m, given)[1]
    used = np.unique(m.class_of[given[1][given[3]]])
    used = used[used < len(m.cuts) - 1]
    assert (np.diff(m.cuts)[used] > 1).sum() > 20
    assert len(calls) == 1


@pytest.mark.parametrize(("block", "cells", "near"), [(1, 1, 1), (5, 90, 40), (36, 400, 1_000)])
def test_gradients_do_not_depend_on_how_much_is_taken_at_once(monkeypatch, block, cells, near):
    m, given = windows()
    want, _ = found(m, given)
    monkeypatch.setattr(gru, "_BLOCK", block)
    monkeypatch.setattr(gru, "_CELLS", cells)
    monkeypatch.setattr(gru, "_NEAR", near)
    got, calls = found(m, given)
    assert len(calls) > 1 and all(a.stop <= b.start for a, b in zip(calls[:-1], calls[1:], strict=True))
    for name, x in want.items():
        assert np.allclose(got[name], x, rtol=1e-4, atol=1e-5), name
    h, ids, _, real = given
    states, total = h, 0.0
    for t in range(len(ids)):
        states = np.where(given[2][t][:, None], 0, states).astype(np.float32)
        total -= gru.log_probs(m, states, ids[t])[real[t]].sum()
        states = gru.advance(m, states, ids[t])
    assert want["loss"] == pytest.approx(total, rel=1e-5) and np.allclose(want["last"], states, atol=1e-5)

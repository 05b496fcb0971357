"""A gated recurrent language model in numpy with a class-factored softmax.

Words are numbered by falling count.  The first ``n`` are the head: each has an embedding and output weights of its
own.  The head is cut into about 2 sqrt(n) classes of neighbouring counts, each with the same share of the square
roots of the counts, so that frequent words lie in small classes.  The ``tails`` numbers after the head each stand for
a set of rarer words and are classes by themselves.  Classes are joined into groups.  A token's probability is that of
its group given the state, times that of its class given group and state, times that of the word given class and state.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

HIDDEN, EMBEDDING, TAILS, STEPS, LANES = 64, 32, 64, 16, 1_024
_DENSE = ("into", "rec", "bias", "grp", "grp_bias", "cls", "cls_bias")
_SPARSE = ("emb", "word", "word_bias")  # a row for each word
_CHUNK, _ROWS = 4_096, 1 << 16
_BLOCK = 512  # lanes taken at once, so that what one step reads and writes stays in a core's cache
_CELLS, _NEAR = 1 << 15, 1_024  # logits and rows of words taken at once in training


@dataclass
class Model:
    cuts: np.ndarray  # where the head's classes begin, and at last its end
    group_cuts: np.ndarray  # where the groups of classes begin, and at last their end
    emb: np.ndarray
    into: np.ndarray
    rec: np.ndarray
    bias: np.ndarray
    grp: np.ndarray
    grp_bias: np.ndarray
    cls: np.ndarray
    cls_bias: np.ndarray
    word: np.ndarray
    word_bias: np.ndarray

    @property
    def class_of(self) -> np.ndarray:
        """The class of each number."""
        n = len(self.cuts) - 1
        return np.concatenate([np.repeat(np.arange(n), np.diff(self.cuts)), np.arange(n, len(self.cls_bias))]).astype(np.int64)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in _DENSE + _SPARSE])

    def filled(self, flat: np.ndarray) -> Model:
        """A model of this shape with the weights of ``flat``."""
        out, at = {}, 0
        for name in _DENSE + _SPARSE:
            like = getattr(self, name)
            out[name], at = flat[at : at + like.size].reshape(like.shape).astype(np.float32), at + like.size
        return replace(self, **out)

    def copy(self) -> Model:
        return replace(self, **{k: getattr(self, k).copy() for k in _DENSE + _SPARSE})


def class_cuts(counts: np.ndarray) -> np.ndarray:
    """Cut words of falling count into about 2 sqrt(n) classes with equal shares of the counts' square roots."""
    n = len(counts)
    if not n:
        return np.zeros(1, np.int64)
    share = np.cumsum(np.sqrt(np.maximum(counts, 1e-9)))
    k = max(1, int(2 * np.sqrt(n)))
    cls = np.minimum((share / share[-1] * k - 1e-9).astype(np.int64), k - 1)
    return np.append(np.flatnonzero(np.append(True, np.diff(cls) > 0)), n)


def fresh(counts: np.ndarray, tails: np.ndarray, hidden: int = HIDDEN, embedding: int = EMBEDDING, seed: int = 11) -> Model:
    """A model that starts as the unigram model of ``counts`` (of the head, falling) and ``tails`` (of the groups of other words)."""
    rng = np.random.default_rng(seed)
    counts = np.asarray(counts, float) + 0.1
    cuts = class_cuts(counts)
    sums = np.add.reduceat(counts, cuts[:-1]) if len(counts) else np.zeros(0)
    share = np.append(sums, np.asarray(tails, float) + 0.1)
    groups = max(1, int(np.sqrt(len(share))))
    group_cuts = np.linspace(0, len(share), groups + 1).astype(np.int64)
    group = np.add.reduceat(share, group_cuts[:-1])
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    log = lambda x: np.log(x).astype(np.float32)
    n = len(counts)
    return Model(
        cuts=cuts,
        group_cuts=group_cuts,
        emb=draw(n + len(tails), embedding, scale=0.3),
        into=draw(embedding, 3 * hidden, scale=embedding**-0.5),
        rec=draw(hidden, 3 * hidden, scale=hidden**-0.5),
        bias=np.zeros(3 * hidden, np.float32),
        grp=draw(groups, hidden, scale=0.05),
        grp_bias=log(group / group.sum()),
        cls=draw(len(share), hidden, scale=0.05),
        cls_bias=log(share / np.repeat(group, np.diff(group_cuts))),
        word=draw(n, hidden, scale=0.05),
        word_bias=log(counts / np.repeat(sums, np.diff(cuts))),
    )


def _cell(m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``into``, ``rec`` and ``bias`` by gate (reset, keep, new), so that what one gate reads or writes lies together."""
    k = m.rec.shape[0]
    into, rec, bias = (np.ascontiguousarray(w.reshape(-1, 3, k).swapaxes(0, 1)) for w in (m.into, m.rec, m.bias))
    return into, rec, bias


def _joined(by_gate: np.ndarray) -> np.ndarray:
    """The way back from ``_cell``."""
    return by_gate.swapaxes(0, 1).reshape(by_gate.shape[1], -1)


def _gates(rec: np.ndarray, h: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The states after one token each, whose part of the gates is ``given[gate]``, and what the way back needs."""
    own = h @ rec
    gates = own[:2]
    gates += given[:2]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    reset, keep = gates
    new = reset * own[2]
    new += given[2]
    new *= -2  # tanh(x) is 2 / (1 + exp(-2 x)) - 1, and exp the faster of the two
    np.exp(new, out=new)
    new += 1
    np.divide(2, new, out=new)
    new -= 1
    out = h - new
    out *= keep
    out += new
    return out, (reset, keep, new, own[2])


def advance(m: Model, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The states after reading one token each."""
    into, rec, bias = _cell(m)
    return _gates(rec, h, m.emb[ids] @ into + bias)[0]


def _logits(weights: np.ndarray, bias: np.ndarray, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Logits with a column or a row for each state, along which axis the choices lie, and each target's place.

    The shorter axis is the outer one: numpy's loops run along the inner one.
    """
    if len(h) > len(weights):
        x, at = weights @ h.T, target * len(h)
        x += bias[:, None]
        at += np.arange(len(h))
        return x, 0, at
    x, at = h @ weights.T, np.arange(0, len(h) * len(weights), len(weights))
    x += bias
    at += target
    return x, 1, at


def _softmax(x: np.ndarray, axis: int, at: np.ndarray) -> np.ndarray:
    """Each target's probability; ``x`` becomes the gradient of the loss by the logits."""
    x -= np.maximum.reduce(x, axis, keepdims=True)
    np.exp(x, out=x)
    x /= np.add.reduce(x, axis, keepdims=True)
    x = x.reshape(-1)
    p = x[at]
    x[at] = p - 1
    return p


def _log_softmax(x: np.ndarray, axis: int, at: np.ndarray) -> np.ndarray:
    x -= np.maximum.reduce(x, axis, keepdims=True)
    logit = x.reshape(-1)[at]
    return logit - np.log(np.add.reduce(np.exp(x, out=x), axis))


def _choices(m: Model, cls: np.ndarray, ids: np.ndarray, layers: tuple[str, ...] = ("word", "cls", "grp")):
    """The softmaxes that tokens sorted by class go through.

    Each is ``(layer, tokens, rows, targets)``: a stretch of the tokens, which choose among ``rows`` of the layer.
    """
    group = (np.searchsorted(m.group_cuts, np.arange(len(m.cls_bias)), side="right") - 1)[cls]
    for layer, parent, cuts, child in (("word", cls, m.cuts, ids), ("cls", group, m.group_cuts, cls)):
        if layer not in layers:
            continue
        starts = np.searchsorted(parent, np.arange(len(cuts)))
        some = np.flatnonzero((np.diff(starts) > 0) & (np.diff(cuts) > 1))
        target = child - cuts[np.minimum(parent, len(cuts) - 1)]
        for lo, hi, a, end in zip(*(x.tolist() for x in (cuts[some], cuts[some + 1], starts[some], starts[some + 1])), strict=True):
            while a < end:
                b = min(a + _CHUNK, end)
                yield layer, slice(a, b), slice(lo, hi), target[a:b]
                a = b
    if "grp" in layers:
        for a in range(0, len(cls), _CHUNK):
            yield "grp", slice(a, a + _CHUNK), slice(0, len(m.grp)), group[a : a + _CHUNK]


def _word_gradients(m: Model, h: np.ndarray, cls: np.ndarray, ids: np.ndarray, up: np.ndarray, step_words) -> list[np.ndarray]:
    """The softmaxes among the words of classes, for tokens sorted by class: sets ``up``, gives the targets' probabilities.

    Classes are taken some neighbours at a time, so that all but their products is done for many at once.
    """
    starts, cuts, found = np.searchsorted(cls, np.arange(len(m.cuts))), m.cuts, []
    n, size = np.diff(starts), np.diff(cuts)
    some = np.flatnonzero((n > 0) & (size > 1))
    target = ids - cuts[np.minimum(cls, len(cuts) - 1)]
    held: list[tuple[int, ...]] = []
    cells = 0

    def settle() -> None:
        low, high = held[0][0], held[-1][1]
        x, views, at = np.empty(cells, h.dtype), [], 0
        for lo, hi, a, b in held:
            end = at + (hi - lo) * (b - a)
            view = x[at:end].reshape(b - a, hi - lo)
            np.matmul(h[a:b], m.word[lo:hi].T, out=view)
            view += m.word_bias[lo:hi]
            views.append(view)
            at = end
        table = np.array(held)
        width = np.repeat(table[:, 1] - table[:, 0], table[:, 3] - table[:, 2])  # of each token's row
        row = np.cumsum(width) - width
        x -= np.repeat(np.maximum.reduceat(x, row), width)
        np.exp(x, out=x)
        x *= np.repeat(1 / np.add.reduceat(x, row), width)
        row += np.concatenate([target[a:b] for _, _, a, b in held])
        p = x[row]
        x[row] = p - 1
        found.append(p)
        d_word, d_bias = np.zeros((high - low, h.shape[1]), h.dtype), np.zeros(high - low, h.dtype)
        for (lo, hi, a, b), view in zip(held, views, strict=True):
            np.matmul(view, m.word[lo:hi], out=up[a:b])
            np.matmul(view.T, h[a:b], out=d_word[lo - low : hi - low])
            np.add.reduce(view, 0, out=d_bias[lo - low : hi - low])
        step_words(slice(low, high), d_word, d_bias)
        held.clear()

    for lo, hi, a, b in zip(*(x.tolist() for x in (cuts[some], cuts[some + 1], starts[some], starts[some + 1])), strict=True):
        more = (hi - lo) * (b - a)
        if held and (cells + more > _CELLS or hi - held[0][0] > _NEAR):
            settle()
            cells = 0
        held.append((lo, hi, a, b))
        cells += more
    if held:
        settle()
    return found


def log_probs(m: Model, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log of each token's probability; of a tail that of its class alone."""
    cls = m.class_of.astype(np.uint16)[ids]
    order = np.argsort(cls, kind="stable")
    h, logp, out = h.take(order, 0), np.zeros(len(ids)), np.empty(len(ids))
    for layer, at, rows, target in _choices(m, cls[order].astype(np.int64), ids[order]):
        logp[at] += _log_softmax(*_logits(getattr(m, layer)[rows], getattr(m, layer + "_bias")[rows], h[at], target))
    out[order] = logp
    return out


def score(m: Model, docs: list[np.ndarray], steps: int = STEPS) -> np.ndarray:
    """Natural log-likelihood of each whole document; the state is carried from window to window."""
    length = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-length, kind="stable")
    total, starts = np.zeros(len(docs)), np.append(0, np.cumsum(length))
    flat = np.concatenate(docs).astype(np.int64) if len(docs) else np.zeros(0, np.int64)
    h = np.zeros((len(docs), m.rec.shape[0]), np.float32)
    falling, t = length[order], 0
    into, rec, bias = _cell(m)
    states, ids, lanes, held = [], [], [], 0

    def settle() -> None:
        tokens = np.concatenate(ids)
        total[:] += np.bincount(np.concatenate(lanes), log_probs(m, np.concatenate(states), tokens), len(docs))
        states.clear(), ids.clear(), lanes.clear()

    live = int((falling > 0).sum())
    while live:
        at = order[:live]
        width = int(min(steps, falling[live - 1] - t))  # no document ends within
        for a in range(0, live, _ROWS // steps):
            lane = at[a : a + _ROWS // steps]
            tokens = flat[starts[lane][None, :] + t + np.arange(width)[:, None]]
            own = h[a : a + len(lane)].copy()
            for s in range(width):
                states.append(own)
                given = m.emb.take(tokens[s], 0) @ into
                given += bias
                own = _gates(rec, own, given)[0]
            h[a : a + len(lane)] = own
            ids.append(tokens.ravel())
            lanes.append(np.tile(lane, width))
            held += tokens.size
            if held >= _ROWS:
                settle()
                held = 0
        t += width
        live = int(np.searchsorted(-falling, -t, side="left"))
        h = h[:live]
    if ids:
        settle()
    return total


def gradients(m: Model, h: np.ndarray, ids: np.ndarray, fresh_at: np.ndarray, real: np.ndarray, class_of: np.ndarray, step_words) -> tuple[dict, tuple, np.ndarray, float]:
    """Gradients of the loss summed over one window ``ids[step, lane]``, the last states and the loss.

    Those of each class's words go to ``step_words(rows, d_word, d_bias)`` as they are found; those of embeddings come
    as ``(ids, rows)``.
    """
    steps, lanes = ids.shape
    k, tok = h.shape[1], ids.ravel()
    into, rec, bias = _cell(m)
    given = m.emb.take(ids, 0)
    seen, last, back = np.empty((steps, lanes, k), h.dtype), np.empty_like(h), []
    for a in range(0, lanes, _BLOCK):
        some, own = slice(a, a + _BLOCK), h[a : a + _BLOCK]
        for t in range(steps):
            now = seen[t, some]
            now[...] = own
            now[fresh_at[t, some]] = 0
            x = given[t, some] @ into
            x += bias
            own, kept = _gates(rec, now, x)
            back.append((x, *kept))
        last[some] = own
    order = np.flatnonzero(real)
    order = order[np.argsort(class_of.astype(np.uint16)[tok[order]], kind="stable")]
    sorted_ids = tok[order]
    own_h = seen.reshape(-1, k).take(order, 0)
    own_up, sorted_cls = np.zeros_like(own_h), class_of[sorted_ids]
    g = {name: np.zeros_like(getattr(m, name)) for name in ("grp", "grp_bias", "cls", "cls_bias")}
    found = _word_gradients(m, own_h, sorted_cls, sorted_ids, own_up, step_words)
    for layer, at, rows, target in _choices(m, sorted_cls, sorted_ids, ("cls", "grp")):
        weights, states = getattr(m, layer)[rows], own_h[at]
        d, axis, their = _logits(weights, getattr(m, layer + "_bias")[rows], states, target)
        found.append(_softmax(d, axis, their))
        if axis:
            d = d.T
        own_up[at] += d.T @ weights
        g[layer][rows] += d @ states
        g[layer + "_bias"][rows] += np.add.reduce(d, 1)
    loss = -float(np.log(np.maximum(np.concatenate(found), np.finfo(h.dtype).tiny)).sum()) if found else 0.0
    up = np.zeros((steps * lanes, k), h.dtype)
    up[order] = own_up
    up = up.reshape(steps, lanes, k)
    del own_h, own_up
    d_rec, d_into, d_bias = (np.zeros_like(w) for w in (rec, into, bias))
    into_back, rec_back = into.swapaxes(1, 2), rec.swapaxes(1, 2)
    for a in reversed(range(0, lanes, _BLOCK)):
        some = slice(a, min(a + _BLOCK, lanes))
        carry = np.zeros((some.stop - a, k), h.dtype)
        passed, d_own, ones = np.empty_like(carry), np.empty((3, *carry.shape), h.dtype), np.ones((1, len(carry)), h.dtype)
        for t in range(steps - 1, -1, -1):
            old, words, (now, reset, keep, new, own) = seen[t, some], given[t, some], back.pop()  # the gates' parts have been read
            d_reset, d_keep, d_new = now
            np.subtract(old, new, out=d_keep)
            new *= new
            np.subtract(1, new, out=new)
            np.subtract(1, keep, out=passed)
            np.multiply(carry, passed, out=d_new)
            d_new *= new
            passed *= keep
            passed *= carry
            d_keep *= passed
            np.multiply(d_new, reset, out=d_own[2])
            np.multiply(d_own[2], own, out=d_reset)
            np.subtract(1, reset, out=reset)
            d_reset *= reset
            d_own[:2] = now[:2]
            d_rec += old.T @ d_own
            d_into += words.T @ now
            d_bias += ones @ now
            carry *= keep
            for d, weights in zip(d_own, rec_back, strict=True):
                carry += np.matmul(d, weights, out=passed)
            carry += up[t, some]
            carry[fresh_at[t, some]] = 0
            np.add.reduce(now @ into_back, 0, out=words)  # this step's embeddings have been read
    g["rec"], g["into"], g["bias"] = _joined(d_rec), _joined(d_into), _joined(d_bias)[0]
    order = np.argsort(tok.astype(np.uint16) if len(m.emb) <= 1 << 16 else tok, kind="stable")
    sorted_ids = tok[order]
    first = np.flatnonzero(np.append(True, np.diff(sorted_ids) != 0))
    return g, (sorted_ids[first], np.add.reduceat(given.reshape(len(tok), -1).take(order, 0), first, axis=0)), last, loss


def train(m: Model, docs: list[np.ndarray], rate: float, steps: int = STEPS, most_lanes: int = LANES) -> tuple[Model, int]:
    """Truncated backpropagation through time, once over ``docs``; a new model and the tokens read.

    The documents lie one after another in lanes of equal length; a state starts anew where a document does.  Weights
    of the recurrent cell and of the classes move by Adam at ``rate``, rows of words by Adagrad at 20 times that.
    """
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)  # as narrow as they come
    n = len(flat)
    if not n:
        return m, 0
    begins = np.zeros(n, bool)
    begins[np.cumsum([0, *[len(d) for d in docs[:-1]]])] = True
    lanes = int(np.clip(n // (steps * 100), 8, most_lanes))
    span = -(-n // (lanes * steps)) * steps
    pad = lanes * span - n
    shape = lambda a, fill: np.append(a, np.full(pad, fill, a.dtype)).reshape(lanes, span).T
    ids, begins, real = shape(flat, len(m.emb) - 1), shape(begins, True), shape(np.ones(n, bool), False)
    del flat
    m, class_of, sparse = m.copy(), m.class_of, 20 * rate
    one, two = ({k: np.zeros_like(getattr(m, k)) for k in _DENSE} for _ in range(2))
    seen_word, seen_emb = np.ones(len(m.word), np.float32), np.ones(len(m.emb), np.float32)
    h = np.zeros((lanes, m.rec.shape[0]), np.float32)
    warm = 1.0

    def step_words(rows: slice, d_word: np.ndarray, d_bias: np.ndarray) -> None:
        seen, bias, word = seen_word[rows], m.word_bias[rows], m.word[rows]  # views
        seen += np.vecdot(d_word, d_word) / d_word.shape[1]
        move = np.sqrt(seen)
        np.divide(sparse * warm, move, out=move)
        bias -= move * d_bias
        d_word *= move[:, None]
        word -= d_word

    for i, a in enumerate(range(0, span, steps), 1):
        warm = min(1.0, i / 20)
        g, (words, rows), h, _ = gradients(m, h, ids[a : a + steps].astype(np.int64), begins[a : a + steps], real[a : a + steps], class_of, step_words)
        seen_emb[words] += np.einsum("ij,ij->i", rows, rows) / rows.shape[1]
        m.emb[words] -= rows * (sparse * warm / np.sqrt(seen_emb[words]))[:, None]
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values())) / max(1, real[a : a + steps].sum())
        scale = min(1.0, 1.0 / max(norm, 1e-9)) / max(1, real[a : a + steps].sum())
        step = rate * warm * np.sqrt(1 - 0.99**i) / (1 - 0.9**i)
        for k, x in g.items():
            x *= scale
            one[k] += 0.1 * (x - one[k])
            two[k] += 0.01 * (x * x - two[k])
            getattr(m, k)[...] -= step * one[k] / (np.sqrt(two[k]) + 1e-8)
    return m, n

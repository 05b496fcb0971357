"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over the words of all benchmark items.  A randomised SVD finds their main
directions: the vectors times a random matrix and back (``A'(A R)``), made orthogonal, and the same once more; each time
summed over all passages where they are read and then in a tree.  Only matrices of the benchmark's vocabulary by
``RANK`` reach the driver.  Documents are encoded once and passed over four times, however many items there are.

Overlapping windows of every whole text are folded into that space and compared with the benchmark items by
cosine; the items are the query set, which a task goes through in blocks of at most ``ITEMS`` and about ``ITEM_WORDS`` words.
Items longer than a window are sought by overlapping pieces of a window's length; a piece's place in its item tells where in
the text the item would lie, ``STRETCH`` times its length.  Each candidate, with its surroundings, is checked
by the longest common subsequence of words with the item: a document is contaminated if it holds ``SURE`` of an item's words
in order, or ``LIKELY`` of them together with the item's answer, its last quarter.  That catches paraphrases that leave out,
add or change some words.  Items of fewer than ``LEAST`` words have no subsequence worth the name: they are found where
a text has exactly their words.

Words are lower-cased and ASCII punctuation separates words.  Null and empty texts match nothing, nor do items without
words.  Repeated rows are found alike.  Without documents or items the result is empty.  The benchmark, but not the
documents, must fit the driver and each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import copied_if_small, grouped, materialize, table
from stationwise.llm.hashing import mix, runs

RANK, OVERSAMPLE, ITEMS, ITEM_WORDS = 64, 8, 500, 30_000
UNIT = 16  # windows of 2 units for short items and of 4 for the others, each half a window after the last
SHORT_ITEM, LEAST = 24, 5
PIECE, STRETCH = 4 * UNIT, 1.5  # of items longer than a window; pieces overlap by half
COSINE = {2: 0.33, 4: 0.42}  # by the units of a window
SURE, LIKELY, ANSWER, ANSWER_PART = 0.8, 0.6, 0.5, 0.25
_FANOUT, KEPT_BLOCKS = 16, 8
_TABLE = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Terms:
    """Numbers of a vocabulary's words; -1 for any other."""

    def __init__(self, words: list[bytes]):
        self.number = {w: i for i, w in enumerate(words)}

    def of(self, text: str | None) -> np.ndarray:
        return np.array(list(map(self.number.get, words_of(text), repeat(-1))), np.int32)


def encoded(docs: DataFrame, vocabulary: list[bytes], text: str = "text") -> DataFrame:
    """``(k_id, k_text, ids)``: the numbers of all words of each text, as int32."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(held.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                ids = [terms.of(t).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], ["k_id", "k_text", "ids"])

    kind = docs.schema["k_id"].dataType.simpleString()
    return docs.select("k_id", "k_text", text).mapInArrow(run, f"k_id {kind}, k_text long, ids binary")


def _units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known words of all encoded texts, the unit each stands in, and the text of each unit."""
    ids = [np.frombuffer(t, np.int32) for t in texts]
    length = np.array([len(i) for i in ids], np.int64)
    units = -(-length // UNIT)
    first = np.append(0, np.cumsum(units))
    flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
    place = np.arange(len(flat)) - np.repeat(np.append(0, np.cumsum(length))[:-1], length)
    unit = np.repeat(first[:-1], length) + place // UNIT
    known = flat >= 0
    return flat[known], unit[known], np.repeat(np.arange(len(texts)), units)


def _sums(group: np.ndarray, weights: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """The sums over each of ``n`` groups of its words' rows of ``weights``, a column at a time."""
    out = np.empty((weights.shape[1], n), np.float32)
    for c, column in enumerate(np.ascontiguousarray(weights.T)):
        out[c] = np.bincount(group, column[term], n)
    return out.T


def _total(docs: DataFrame, work: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
    """The sum over all texts of ``work``'s matrix, of a bounded size: by task, then some at a time in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = work(batch.column(0).slice(a, 1_000).to_pylist())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["part", "total"])

    def add(key: int, rows: list[tuple]) -> pa.RecordBatch:
        total = np.sum([np.frombuffer(r[0]) for r in rows], axis=0)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    schema = "part long, total binary"
    parts = docs.rdd.getNumPartitions()
    few = docs.select("ids").coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-parts // 8)))  # a sum for every eight files
    sums = materialize(few.mapInArrow(run, schema), "sums")
    while sums.count() > 1:
        sums = materialize(grouped(sums.withColumn("part", F.floor(F.col("part") / _FANOUT)), "part", add, schema), "sums")
    row = sums.first()
    shape = work([]).shape
    return np.zeros(shape) if row is None else np.frombuffer(bytes(row.total)).reshape(shape)


def latent_space(docs: DataFrame, n: int, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """A row for each of ``n`` words of ``encoded`` texts: its part of a passage's place in the latent space.

    That is the IDF, the directions, and one over the singular values.
    """
    spark = docs.sparkSession

    def passages(texts: list[bytes]) -> np.ndarray:
        """In how many passages (of two units) each word stands, and at the end how many there are."""
        term, unit, of = _units(texts)
        pair = np.unique(unit.astype(np.int64) // 2 * n + term)
        return np.append(np.bincount(pair % n, minlength=n), -(-len(of) // 2)).astype(np.float64)

    df = _total(docs, passages)
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)).astype(np.float32)

    def back(weights: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast((idf, weights))

        def work(texts: list[bytes]) -> np.ndarray:
            idf, weights = sent.value
            if not texts:
                return np.zeros(weights.shape)
            term, unit, of = _units(texts)
            passage, out = unit // 2, np.empty((weights.shape[1], n))
            for c, column in enumerate(np.ascontiguousarray((weights * idf[:, None]).T)):
                out[c] = np.bincount(term, np.bincount(passage, column[term])[passage], n)
            return out.T * idf[:, None]

        return _total(docs, work)

    # M = A'A is seen only as Z = M R, twice; its main directions and singular values follow from the last R and Z (Nystroem)
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, rank + OVERSAMPLE))))[0]
    r = np.linalg.qr(back(r.astype(np.float32)) + 1e-9 * r)[0]
    z = back(r.astype(np.float32))
    shift = 1e-7 * max(np.linalg.norm(z), 1e-9)
    z = z + shift * r
    half = np.linalg.cholesky((r.T @ z + z.T @ r) / 2 + shift * np.eye(r.shape[1]))
    directions, values, _ = np.linalg.svd(np.linalg.solve(half, z.T).T, full_matrices=False)
    values = values**2 - shift
    best = np.flatnonzero(values > max(1e-9, values[0] * 1e-9))[:rank]
    return (idf[:, None] * directions[:, best] / np.sqrt(values[best])).astype(np.float32)


class Items:
    """Word numbers of the items, and for each item and word the places at which the item has it, as bits.

    ``share`` takes the last part of each item only.
    """

    def __init__(self, ids: list[np.ndarray], terms: int, share: float = 1.0):
        self.ids = [i[len(i) - max(1, int(len(i) * share)) :] if len(i) else i for i in ids]
        self.length = np.array([len(i) for i in self.ids], np.int64)
        self.bits = np.zeros((len(ids), terms), np.uint64)
        for k, item in enumerate(self.ids):
            if len(item) <= 64:
                np.bitwise_or.at(self.bits[k], item, np.uint64(1) << np.arange(len(item), dtype=np.uint64))

    def covered(self, item: np.ndarray, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many of each item's words the passage ``term[lo:hi]`` has anywhere: no common subsequence is longer."""
        out = self.length[item].copy()
        for i in np.flatnonzero(out > 64):
            out[i] = np.isin(self.ids[item[i]], term[lo[i] : hi[i]]).sum()
        for a in range(0, len(item), 5_000):
            width = hi[a : a + 5_000] - lo[a : a + 5_000]
            some = np.flatnonzero((width > 0) & (self.length[item[a : a + 5_000]] <= 64))
            if len(some):
                at, width = some + a, width[some]
                first = np.append(0, np.cumsum(width)[:-1])
                places = np.arange(int(width.sum())) + np.repeat(lo[at] - first, width)
                out[at] = np.bitwise_count(np.bitwise_or.reduceat(self.bits[np.repeat(item[at], width), term[places]], first))
        return out

    def common(self, item: np.ndarray, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each item and passage ``term[lo:hi]``, by bits in parallel."""
        out = np.zeros(len(item), np.int64)
        for i in np.flatnonzero(self.length[item] > 64):
            out[i] = _long_common(self.ids[item[i]], term[lo[i] : hi[i]])
        short = np.flatnonzero(self.length[item] <= 64)
        for a in range(0, len(short), 50_000):
            at = short[a : a + 50_000]
            at = at[np.argsort(lo[at] - hi[at], kind="stable")]  # the longest passages first
            width, which = hi[at] - lo[at], item[at]
            v = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
            for k in range(int(width[0]) if len(at) else 0):
                live = int(np.searchsorted(-width, -k, side="left"))
                u = v[:live] & self.bits[which[:live], term[lo[at[:live]] + k]]
                v[:live] = (v[:live] + u) | (v[:live] - u)
            out[at] = np.bitwise_count(~v)
        return out


def _long_common(item: np.ndarray, passage: np.ndarray) -> int:
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    v = whole = (1 << len(item)) - 1
    for w in passage.tolist():
        u = v & places.get(w, 0)
        v = (v + u | v - u) & whole
    return len(item) - v.bit_count()


class Pieces:
    """What the items are sought by: themselves, or overlapping pieces of those longer than a window."""

    def __init__(self, ids: list[np.ndarray], space: np.ndarray):
        at = [(k, o) for k, i in enumerate(ids) for o in (*range(0, max(0, len(i) - PIECE), PIECE // 2), max(0, len(i) - PIECE))]
        self.item, self.offset = np.array(at, np.int64).reshape(-1, 2).T
        self.length = np.array([min(PIECE, len(ids[k])) for k, _ in at], np.int64)
        self.cut = np.array([len(ids[k]) > PIECE for k, _ in at], bool)
        self.after = np.array([len(ids[k]) for k, _ in at], np.int64) - self.offset - self.length
        self.place = np.array([space[ids[k][o : o + PIECE]].sum(0) for k, o in at])
        self.place /= np.maximum(np.linalg.norm(self.place, axis=1, keepdims=True), 1e-9)

    def around(self, piece: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """How many units before and after a window that looks like the piece its item may reach."""
        reach = lambda words: np.ceil(STRETCH * words / UNIT).astype(np.int64) * self.cut[piece] + width // 2
        return reach(self.offset[piece]), reach(self.after[piece])


class Block:
    """Some items, ready to be compared: their pieces, and bits over the words that they have."""

    def __init__(self, first: int, ids: list[np.ndarray], space: np.ndarray):
        self.first, self.pieces = first, Pieces(ids, space)
        own = np.unique(np.concatenate(ids))
        self.local = np.full(len(space) + 1, len(own), np.int32)  # the last local number: a word that no item here has
        self.local[own] = np.arange(len(own))
        ids = [self.local[i] for i in ids]
        self.whole, self.tails = Items(ids, len(own) + 1), Items(ids, len(own) + 1, ANSWER_PART)


class Shorts:
    """Items of fewer than ``LEAST`` words, found by their exact words."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.by_length = {n: [(k, i) for k, i in items if len(i) == n] for n in range(1, LEAST)}
        self.hashes = {n: runs_of(np.concatenate([i for _, i in own]), n)[::n] for n, own in self.by_length.items() if own}

    def found(self, texts: list[np.ndarray]) -> list[tuple]:
        """``(text, item, words)``."""
        out = set()
        for n, hashes in self.hashes.items():
            order = np.argsort(hashes, kind="stable")
            for d, ids in enumerate(texts):
                own = runs_of(ids, n)
                for at in np.flatnonzero(np.isin(own, hashes)).tolist():
                    lo, hi = (np.searchsorted(hashes[order], own[at], side=x) for x in ("left", "right"))
                    out |= {(d, self.by_length[n][k][0], n) for k in order[lo:hi] if (self.by_length[n][k][1] == ids[at : at + n]).all()}
        return sorted(out)


def runs_of(ids: np.ndarray, n: int) -> np.ndarray:
    return runs(mix(ids.astype(np.int64).view(np.uint64)), n)


def _search(docs: DataFrame, items: list[tuple], vocabulary: list[bytes], space: np.ndarray) -> DataFrame:
    """``(k_id, k_text, item_id, item_words, lcs, ratio, cosine, answer)``: the best place of each item in each text."""
    held = docs.sparkSession.sparkContext.broadcast((items, vocabulary, space))  # as large as the benchmark
    kind = docs.schema["k_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, vocabulary, space = held.value
        terms = Terms(vocabulary)
        ids = [terms.of(t) for _, t in items]
        shorts = Shorts([(k, i) for k, i in enumerate(ids) if 0 < len(i) < LEAST])
        spans = _blocks([len(i) for i in ids])
        made = lambda a, b: Block(a, ids[a:b], space)
        kept = [made(a, b) for a, b in spans] if len(spans) <= KEPT_BLOCKS else None
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = part.column(2).to_pylist()
                windows, rows = Windows(texts, space), []
                for block in kept if kept is not None else (made(*span) for span in spans):
                    rows += candidates(windows, block)
                rows += [(d, k, n, 1.0, 1.0) for d, k, n in shorts.found([np.frombuffer(t, np.int32) for t in texts])]
                if rows:
                    doc, item, lcs, cos, answer = (np.array(c) for c in zip(*rows, strict=True))
                    take = pa.array(doc.astype(np.int64))
                    words = np.array([len(ids[i]) for i in item.astype(int)])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), pa.array([items[i][0] for i in item.astype(int)], pa.int64()), pa.array(words), pa.array(lcs.astype(np.int64)), pa.array(lcs / words), pa.array(cos.astype(np.float64)), pa.array(answer.astype(np.float64))],
                        ["k_id", "k_text", "item_id", "item_words", "lcs", "ratio", "cosine", "answer"],
                    )

    return docs.select("k_id", "k_text", "ids").mapInArrow(run, f"k_id {kind}, k_text long, item_id long, item_words long, lcs long, ratio double, cosine double, answer double")


class Windows:
    """The units of some texts, and the places of windows of two and four units in the latent space."""

    def __init__(self, texts: list[bytes], space: np.ndarray):
        self.term, unit, self.of = _units(texts)
        n = self.n = len(self.of)
        self.bounds = np.searchsorted(unit, np.arange(n + 1))
        self.last = np.searchsorted(self.of, self.of, side="right")  # one after the text's last unit
        self.first = np.searchsorted(self.of, self.of, side="left")
        sums = np.zeros((n, space.shape[1]), np.float32)
        for a in range(0, n, 8_192):
            lo, hi = self.bounds[a], self.bounds[min(n, a + 8_192)]
            sums[a : a + 8_192] = _sums(unit[lo:hi] - a, space, self.term[lo:hi], len(sums[a : a + 8_192]))
        two = sums + self._after(sums, 1) if n > 1 else sums
        self.starts, self.places = {}, {}
        for width, places in ((2, two), (4, two + self._after(two, 2) if n > 2 else two)):
            s = self.starts[width] = np.flatnonzero((np.arange(n) - self.first) % (width // 2) == 0)
            self.places[width] = places[s] / np.maximum(np.linalg.norm(places[s], axis=1, keepdims=True), 1e-9)

    def _after(self, rows: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(rows)
        out[: self.n - k] = rows[k:] * (self.of[k:] == self.of[: self.n - k])[:, None]
        return out


def candidates(windows: Windows, block: Block) -> list[tuple]:
    """``(text, item, lcs, cosine, answer)`` of the contaminated texts; the surest place of each item."""
    found: list[tuple[np.ndarray, ...]] = []
    whole, tails, pieces, of, bounds = block.whole, block.tails, block.pieces, windows.of, windows.bounds
    term = block.local[windows.term]
    is_long = pieces.length > SHORT_ITEM
    for width, chosen in ((2, np.flatnonzero(~is_long)), (4, np.flatnonzero(is_long))):
        starts = windows.starts[width]
        some = 5_000 * ITEMS // max(ITEMS, len(chosen))
        for a in range(0, len(starts) if len(chosen) else 0, some):
            s = starts[a : a + some]
            cos = windows.places[width][a : a + some] @ pieces.place[chosen].T
            r, c = np.nonzero(cos >= COSINE[width])
            before, behind = pieces.around(chosen[c], width)
            lo = np.maximum(windows.first[s[r]], s[r] - before)
            hi = np.minimum(windows.last[s[r]], s[r] + width + behind)
            found.append((bounds[lo], bounds[hi], pieces.item[chosen[c]], cos[r, c], of[s[r]]))
    if not found:
        return []
    lo, hi, item, cos, doc = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((-cos, hi, lo, item))  # several pieces may point to one passage: the likest stands for them
    new = np.append(True, (np.diff(item[order]) != 0) | (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0))[: len(order)]
    lo, hi, item, cos, doc = (c[order[new]] for c in (lo, hi, item, cos, doc))
    able = np.flatnonzero(whole.covered(item, term, lo, hi) >= LIKELY * whole.length[item])
    lo, hi, item, cos, doc = (c[able] for c in (lo, hi, item, cos, doc))
    lcs = whole.common(item, term, lo, hi)
    near = np.flatnonzero(lcs >= LIKELY * whole.length[item])
    lo, hi, item, cos, doc, lcs = (c[near] for c in (lo, hi, item, cos, doc, lcs))
    share = tails.common(item, term, lo, hi) / np.maximum(1, tails.length[item])
    sure = np.flatnonzero((lcs >= SURE * whole.length[item]) | (share >= ANSWER))
    best: dict[tuple[int, int], tuple] = {}
    for k in sure.tolist():
        row = (int(doc[k]), block.first + int(item[k]), int(lcs[k]), float(cos[k]), float(share[k]))
        if (old := best.get(row[:2])) is None or (old[2], old[3]) < (row[2], row[3]):
            best[row[:2]] = row
    return list(best.values())


def _blocks(lengths: list[int]) -> list[tuple[int, int]]:
    """Stretches of the items that have at least ``LEAST`` words, ``ITEMS`` at a time, or fewer where they have many words."""
    spans, first, n = [], None, 0
    for k, size in enumerate([*lengths, 0]):
        if first is not None and (size < LEAST or k - first == ITEMS or n + size > ITEM_WORDS):
            spans.append((first, k))
            first, n = None, 0
        if size >= LEAST:
            first, n = (k if first is None else first), n + size
    return spans


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item that it holds, by the document's id and a hash of its text."""
    rows = docs.select(F.col(doc_id).alias("k_id"), F.xxhash64(text, F.length(text)).alias("k_text"), F.col(text).alias("text"))
    items = [(r.item_id, r.text) for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator()]
    items.sort(key=lambda item: len(words_of(item[1])) < LEAST)  # short ones last, so that blocks stay whole
    vocabulary = sorted({w for _, t in items for w in words_of(t)})
    if not vocabulary:
        kind = rows.schema["k_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"k_id {kind}, k_text long, item_id long, item_words long, lcs long, ratio double, cosine double, answer double")
    known = materialize(encoded(rows, vocabulary), "benchmark-words")
    return _search(known, items, vocabulary, latent_space(known, len(vocabulary)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that hold a benchmark item."""
    gone = materialize(contaminated(docs, benchmark, doc_id, text).select(F.col("k_id").alias("_g"), F.col("k_text").alias("_h")).distinct(), "contaminated")
    own = docs.withColumn("_t", F.xxhash64(text, F.length(text)))
    return own.join(copied_if_small(gone, 16), F.col(doc_id).eqNullSafe(F.col("_g")) & F.col("_t").eqNullSafe(F.col("_h")), "left_anti").drop("_t")


def op5_latent_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("k_id").alias("doc_id"), "item_id", "item_words", "lcs", F.round("ratio", 6).alias("ratio"))

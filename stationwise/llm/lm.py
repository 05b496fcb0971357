"""Scores of whole documents by a gated recurrent language model trained on the corpus.

1. Token counts of all training documents, pre-aggregated where they are read.
2. Training: every training document once.  Documents are dealt to shards of about ``SHARD_TOKENS`` tokens; each
   shard trains its own copy by truncated backpropagation through time, and the copies are averaged, weighted by
   tokens, in a tree.  That happens ``len(RATES)`` times, each on its own part of every shard's documents.
3. Scoring: whole documents, the state carried from window to window.

The softmax is factored into groups, classes and words (see ``gru``).  The ``WORDS`` most frequent words have embeddings and
output weights of their own.  All other words, counted or not, are dealt by their last two bytes to ``gru.TAILS`` sets, which
the model reads and predicts; within a set, a word's probability is its share of the set's counts, one added to each and to a
single unknown word.  Counts of the ``HEAD`` most frequent words go with the tasks; a document's other words meet their
counts in a join.  Words are known by 64-bit hashes.

ASCII letters are lower-cased; each document ends with an end token.  Null texts are empty: the end token alone.
A null id is hashed as the empty text.  Repeated rows are scored alike; an empty table gives an empty result; without
training documents the counts are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm import gru
from stationwise.llm.common import grouped, materialize, table
from stationwise.llm.hashing import word_edges, word_hashes

SHARD_TOKENS, SCORED_TOKENS = 8_000_000, 2_000_000
HEAD, WORDS = 200_000, (1 << 16) - gru.TAILS
RATES = (0.02, 0.015, 0.01)
END = b" "  # no word holds a space
PIECES = 32
_FANOUT, _PART = 16, 2 << 20


def tail_of(word: bytes) -> int:
    """Which set of rarer words a word belongs to, by its last two bytes."""
    return (31 * word[-1] + (word[-2] if len(word) > 1 else 7)) % gru.TAILS


_END_HASH = word_hashes(END, np.zeros(1, np.int64), np.ones(1, np.int64))[0]


class Codes:
    """Numbers of the words of some texts in the order of their first use."""

    @staticmethod
    def read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' codes, the number of tokens of each text, and the hash and tail of each code."""
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() + b"\n" for t in texts]
        text = b"".join(raw)
        starts, ends = word_edges(text)
        last = np.searchsorted(starts, np.cumsum([len(t) for t in raw]))  # an end follows each text's last word
        byte = np.frombuffer(text, np.uint8)
        before = np.where(ends - starts > 1, byte[ends - 2], 7).astype(np.int64)
        tails = np.insert((31 * byte[ends - 1].astype(np.int64) + before) % gru.TAILS, last, tail_of(END))
        hashes, first, which = np.unique(np.insert(word_hashes(text, starts, ends), last, _END_HASH), return_index=True, return_inverse=True)
        order = np.argsort(first)
        code = np.empty(len(order), np.int64)
        code[order] = np.arange(len(order))
        return code[which], np.diff(last, prepend=0) + 1, hashes[order], tails[first[order]]


def parts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a column, about ``_PART`` characters at a time, and the place of the first."""
    at, held, size = 0, [], 0
    for i, t in enumerate(column.to_pylist()):
        held.append(t)
        size += len(t or "") + 16
        if size > _PART:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def count_tokens(docs: DataFrame, text: str = "text", flush: int = 1_000_000) -> DataFrame:
    """``(token, tail, c)`` over all documents; the token is a word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            token, first, which = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
            c = np.bincount(which, np.concatenate([h[2] for h in held])).astype(np.int64)
            tail = np.concatenate([h[1] for h in held])[first]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(c)], ["token", "tail", "c"])

        for batch in batches:
            for _, texts in parts(batch.column(0)):
                which, _, hashes, tails = Codes.read(texts)
                held.append((hashes, tails, np.bincount(which)))
                n += len(hashes)
                if n > flush:
                    yield out()
                    n = 0
        if held:
            yield out()

    return docs.select(text).mapInArrow(run, "token long, tail int, c long").groupBy("token").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


def frequent_tokens(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes, counts and tails of at most ``most`` frequent tokens: all from the least count for which so few remain."""
    step = F.floor(F.log2("c") * 16).cast("int")
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(step).count().collect()), reverse=True)  # at most 16 for each doubling
    total, least = 0, None
    for k, n in steps:
        total += n
        if total > most:
            break
        least = k
    head = counts.where(step >= least if least is not None else F.lit(False)).toPandas()
    head = head.sort_values(["c", "token"], ascending=[False, True])
    return head["token"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64), head["tail"].to_numpy(np.int64)


class Lookup:
    """Places of known hashes; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


def _encoded(docs: DataFrame, short: np.ndarray) -> DataFrame:
    """``(shard, ids)`` from ``(shard, text)``."""
    held = docs.sparkSession.sparkContext.broadcast(short)  # at most ``WORDS`` hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_short = Lookup(held.value), len(held.value)
        for batch in batches:
            for at, texts in parts(batch.column(1)):
                which, n, hashes, tails = Codes.read(texts)
                place = known.of(hashes)
                ids = np.where(place < 0, n_short + tails, place).astype(np.uint16)[which]
                blobs = [i.tobytes() for i in np.split(ids, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(blobs, pa.binary())], ["shard", "ids"])

    return docs.select("shard", "text").mapInArrow(run, "shard long, ids binary")


def _pieces(key: int, flat: np.ndarray, n: int) -> pa.RecordBatch:
    """A shard's weights in ``PIECES`` rows ``(place, model, n)``, so that no row is large; they travel in 16 bits."""
    parts = np.array_split(flat.astype(np.float16), PIECES)
    return pa.RecordBatch.from_arrays([pa.array(key * PIECES + np.arange(PIECES)), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([n] * PIECES, pa.int64())], ["place", "model", "n"])


def _averaged(models: DataFrame) -> np.ndarray | None:
    """The token-weighted mean of shards' weights, piece by piece and some shards at a time."""

    def mean(key: int, rows: list[tuple]) -> pa.RecordBatch:
        n, total = sum(k for _, k in rows), 0.0
        for m, k in rows:
            total = total + np.frombuffer(m, np.float16).astype(np.float32) * (k / max(1, n))
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total.astype(np.float16).tobytes()], pa.binary()), pa.array([n], pa.int64())], ["place", "model", "n"])

    models, schema = materialize(models, "models"), "place long, model binary, n long"
    while models.count() > PIECES:
        shard, piece = F.floor(F.col("place") / (PIECES * _FANOUT)), F.pmod(F.col("place"), F.lit(PIECES))
        up = models.select((shard * PIECES + piece).alias("place"), "model", "n")
        models = materialize(grouped(up, "place", mean, schema), "models")
    rows = models.orderBy("place").collect()  # one model
    return np.concatenate([np.frombuffer(bytes(r.model), np.float16).astype(np.float32) for r in rows]) if rows else None


def train(docs: DataFrame, start: gru.Model, short: np.ndarray, n_tokens: int, text: str = "text", rates: tuple = RATES) -> gru.Model:
    """Weights after all of ``docs``; they and the hashes of the words they stand for are all that passes through the driver."""
    shards = max(1, math.ceil(n_tokens / SHARD_TOKENS))
    place = F.xxhash64(text, F.length(text), "k_id")
    dealt = docs.select(F.pmod(place, F.lit(shards)).alias("shard"), F.pmod(F.floor(place / shards), F.lit(len(rates))).alias("turn"), F.col(text).alias("text"))
    model = start
    for turn, rate in enumerate(rates):
        held = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by ``WORDS``

        def shard(key: int, rows: list[tuple], held=held, rate=rate) -> pa.RecordBatch:
            order = np.random.default_rng(key).permutation(len(rows))
            made, n = gru.train(held.value, [np.frombuffer(rows[i][0], np.uint16) for i in order], rate)
            flat = made.flat()
            if not np.isfinite(flat).all():
                raise FloatingPointError(f"training left the range of numbers in shard {key}, turn {turn}")
            return _pieces(key, flat, n)

        found = _averaged(grouped(_encoded(dealt.where(F.col("turn") == turn), short), "shard", shard, "place long, model binary, n long"))
        held.destroy()  # the averaged weights are written and read
        if found is not None:
            model = model.filled(found)
    return model


def score_documents(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", head: int = HEAD, words: int = WORDS) -> DataFrame:
    """``(k_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("k_id"), F.xxhash64(text, F.length(text)).alias("k_text"), training.alias("learn"), F.col(text).alias("text"))
    learn = rows.where("learn")
    counts = materialize(count_tokens(learn), "token-counts")
    # a row for each tail: the words and counts that are its
    by_tail = {r.tail: r for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    total, distinct = (np.array([by_tail[k][f] if k in by_tail else 0 for k in range(gru.TAILS)], np.int64) for f in ("c", "n"))
    n_all, n_distinct = int(total.sum()), int(distinct.sum())
    hashes, common, tails = frequent_tokens(counts, head)
    n_short = min(len(hashes), words)
    own = lambda weights=None: np.bincount(tails[:n_short], weights, gru.TAILS).astype(np.int64)
    rare, kinds = total - own(common[:n_short]), distinct - own()
    model = train(learn, gru.fresh(common[:n_short], rare), hashes[:n_short], n_all)
    base_norm, tail_norm = math.log10(n_all + n_distinct + 1), np.log10(rare + kinds + 1.0)

    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model, hashes, np.log10(common + 1.0)))  # bounded by ``words`` and ``head``
    kind = rows.schema["k_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes, logs = held.value
        known = Lookup(hashes)
        held_ids, held_rows, waiting = [], [], 0

        def scored_rows() -> pa.RecordBatch:
            """The documents' own rows; many are scored in step, so that long ones do not run alone."""
            keys = pa.Table.from_batches([r[0] for r in held_rows]).combine_chunks().to_batches()[0]
            n, n_known, log_c, rest = (np.concatenate(c) for c in list(zip(*held_rows, strict=True))[1:])
            score = gru.score(model, held_ids) / math.log(10) + rest
            out = pa.RecordBatch.from_arrays([*keys.columns, pa.nulls(len(n), pa.int64()), pa.array(np.ones(len(n), np.int64)), pa.array(n), pa.array(n_known), pa.array(log_c - n * base_norm), pa.array(score)], names)
            held_ids.clear()
            held_rows.clear()
            return out

        for batch in batches:
            for at, texts in parts(batch.column(3)):
                which, n, word, tail = Codes.read(texts)
                place = known.of(word)
                often, listed = place >= 0, (place >= 0) & (place < n_short)
                log_c = np.where(often, logs[place] if len(logs) else 0.0, 0.0)
                rest = np.where(listed, 0.0, log_c - tail_norm[tail])
                held_ids += np.split(np.where(listed, place, n_short + tail).astype(np.uint16)[which], np.cumsum(n)[:-1])
                doc = np.repeat(np.arange(len(n)), n)
                keys = batch.slice(at, len(texts)).select(["k_id", "k_text", "learn"])
                held_rows.append((keys, n, np.bincount(doc, often[which], len(n)).astype(np.int64), np.bincount(doc, log_c[which], len(n)), np.bincount(doc, rest[which], len(n))))
                left = np.flatnonzero(~often[which])
                for a in range(0, len(left), 100_000):
                    some = left[a : a + 100_000]
                    their = keys.take(pa.array(doc[some]))
                    none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([*their.columns, pa.array(word[which[some]].view(np.int64)), *none], names)
                waiting += len(which)
                if waiting > SCORED_TOKENS:
                    yield scored_rows()
                    waiting = 0
        if held_rows:
            yield scored_rows()

    names = ["k_id", "k_text", "learn", "token", "n_docs", "n_tokens", "n_known", "base", "score"]
    scored = rows.mapInArrow(run, f"k_id {kind}, k_text long, learn boolean, token long, n_docs long, n_tokens long, n_known long, base double, score double")
    # a document's own row has no token: a number that only tells such rows apart takes its place, so that they spread
    scored = scored.withColumn("mark", F.col("token").isNull()).withColumn("token", F.coalesce("token", F.xxhash64("k_id", "k_text")))
    met = scored.join(counts, "token", "left").withColumn("c", F.when(~F.col("mark"), F.coalesce("c", F.lit(0))))
    log_c = F.coalesce(F.log10(F.col("c") + 1.0), F.lit(0.0))
    per = met.groupBy("k_id", "k_text", "learn").agg(
        F.sum("n_docs").alias("rows"), F.sum("n_tokens").alias("n_tokens"), (F.sum("n_known") + F.count_if(F.col("c") > 0)).alias("n_known"),
        (F.sum("base") + F.sum(log_c)).alias("base"), (F.sum("score") + F.sum(log_c)).alias("score"),
    )
    # rows that repeat id and text are summed alike: each gets its share
    each = per.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    share = lambda c: (F.col(c) / F.col("rows")).alias(c)
    return each.select("k_id", (~F.col("learn")).alias("held_out"), share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), share("base").alias("base_score"), share("score").alias("score"))


def op3_gated_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2
    return score_documents(table(spark, sf_dir, "documents"), training).withColumnRenamed("k_id", "doc_id")

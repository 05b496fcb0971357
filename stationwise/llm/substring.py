"""Substring dedup: repeated windows of words found by an FM-index per shard.

Text that can repeat is first brought together.  Every window of ``WINDOW`` words has an anchor, the run of
``ANCHOR`` words in it with the least hash, so equal windows have equal anchors.  Neighbouring windows with one
anchor form a context.  Anchors of one document only are dropped; equal contexts (by a 128-bit digest of their words)
are kept once, with the least document that holds them.  The contexts left, by their anchors, make up the shards.

In a shard, a compressed FM-index of the contexts' words is built, and all contexts are streamed through it by backward
search over its wavelet matrix, which gives their matching statistics.  Where they reach the window, a query for the
least owner over the search's interval tells whether an earlier document holds the window; such windows are reported
as maximal ranges of words.  Documents that hold a context of an earlier owner repeat it whole.

An anchor with more than ``HOT`` different contexts (a very large group of near copies) is cut finer: each of its
windows becomes a context with an anchor of its own, which goes to a shard and is searched there like any other, so
that no shard holds a whole group.

Null texts have no words.  Rows that repeat an id are one document and do not repeat each other; rows with a null
id are kept whole and count as nobody's earlier document.  An empty table gives an empty result; columns that
clash with the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import materialize, table, without
from stationwise.llm.fm_index import FMIndex
from stationwise.llm.hashing import runs, word_edges, word_hashes

WINDOW, ANCHOR, HOT, SHARD_CONTEXTS = 50, 20, 20_000, 4_000
_PLACE = 22  # bits of a packed key that hold a place


class Canonical:
    """A text's words joined by one space, and where each begins."""

    def __init__(self, text: str):
        self.joined = b" ".join(text.encode("utf-8", "surrogatepass").split())
        starts, ends = word_edges(self.joined)
        self.at = np.append(starts, ends[-1:] + 1) if len(starts) else np.zeros(1, np.int64)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.joined, self.at[:-1], self.at[1:] - 1)

    def stretches(self, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The words from ``start`` to before ``end``, joined."""
        return [self.joined[a : b - 1] for a, b in zip(self.at[start].tolist(), self.at[end].tolist(), strict=True)]


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least hash in each stretch of ``width``; of equal ones the first."""
    n = len(hashes) - width + 1
    if len(hashes) >= 1 << _PLACE:
        return np.concatenate([np.lib.stride_tricks.sliding_window_view(hashes[a : a + 8_191 + width], width).argmin(1) + a for a in range(0, n, 8_192)])
    low = np.uint64((1 << _PLACE) - 1)
    least, k = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1
    while 2 * k <= width:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
    return (least & low).astype(np.int64)


def contexts(words: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """``(start, windows, anchor hash)`` of the contexts of a text's word hashes."""
    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    grams = runs(words, anchor)
    at = least_places(grams, window - anchor + 1)
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return start, np.append(start[1:], n) - start, grams[at[start]]


def _digests(stretches: list[bytes]) -> pa.Array:
    import xxhash

    return pa.array([xxhash.xxh3_128_digest(s) for s in stretches], pa.binary())


_CONTEXT = ["k_id", "k_text", "at", "n", "anchor", "context"]


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(anchor, lo, hi)``: the least and largest document of each anchor of a batch of texts."""
    kind = docs.schema["k_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            found = [contexts(word_hashes(t, *word_edges(t)), window, anchor)[2] for t in raw]
            if found:
                take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                rows = pa.table({"anchor": pa.array(np.concatenate(found).view(np.int64)), "k_id": batch.column(0).take(take)})
                rows = rows.group_by("anchor").aggregate([("k_id", "min"), ("k_id", "max")]).select(["anchor", "k_id_min", "k_id_max"])
                yield from rows.rename_columns(["anchor", "lo", "hi"]).combine_chunks().to_batches()

    return docs.select("k_id", "text").mapInArrow(run, f"anchor long, lo {kind}, hi {kind}")


def _contexts(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(k_id, k_text, at, n, anchor, context)``: first word, number of windows, anchor's hash and digest of the words."""
    kind = docs.schema["k_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found, digests = [], []
                for t in part.column(2).to_pylist():
                    text = Canonical(t)
                    start, n, grams = contexts(text.hashes(), window, anchor)
                    found.append((start, n, grams))
                    digests.append(_digests(text.stretches(start, start + n + window - 1)))
                take = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                start, n, grams = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(grams.view(np.int64)), pa.concat_arrays(digests)], _CONTEXT
                )

    return docs.select("k_id", "k_text", "text").mapInArrow(run, f"k_id {kind}, k_text long, at int, n int, anchor long, context binary")


def _located(located: DataFrame, docs: DataFrame) -> DataFrame:
    """``(k_id, k_text, text, parts)``: documents with those of their contexts that ``located`` names."""
    wanted = located.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("at", "n", "anchor", "context")).alias("parts"))
    wanted = materialize(wanted.withColumnsRenamed({"k_id": "w_id", "k_text": "w_text"}), "contexts-wanted")
    return docs.join(wanted, (F.col("k_id") == F.col("w_id")) & (F.col("k_text") == F.col("w_text"))).select("k_id", "k_text", "text", "parts")


def _finer(located: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The windows of the contexts that ``located`` names, each as a context with an anchor of its own."""
    kind = docs.schema["k_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = Canonical(batch.column(2)[k].as_py())
                at = np.concatenate([np.arange(p["at"], p["at"] + p["n"]) for p in batch.column(3)[k].as_py()])
                own = runs(text.hashes(), window)[at]
                take = pa.array(np.full(len(at), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(np.ones(len(at), np.int32)), pa.array(own.view(np.int64)), _digests(text.stretches(at, at + window))], _CONTEXT
                )

    return _located(located, docs).mapInArrow(run, f"k_id {kind}, k_text long, at int, n int, anchor long, context binary")


def _with_words(located: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """``(anchor, context, owner, words)``: the words of contexts, from the document that ``located`` names."""
    kind = docs.schema["k_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                out: list[tuple] = []
                for doc, t, parts in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    at, n = (np.array([p[c] for p in parts], np.int64) for c in ("at", "n"))
                    out += [(p["anchor"], p["context"], doc, w) for p, w in zip(parts, Canonical(t).stretches(at, at + n + window - 1), strict=True)]
                kinds = [pa.int64(), pa.binary(), part.column(0).type, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "context", "owner", "words"])

    return _located(located, docs).mapInArrow(run, f"anchor long, context binary, owner {kind}, words binary")


def _searched(parts: DataFrame, window: int) -> DataFrame:
    """``(anchor, context, early)``: the ranges of a context's words in windows that a smaller document than its owner holds."""
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, {}

        def out() -> pa.RecordBatch:
            keys = list(rows)
            owners = sorted({o for o, _ in rows.values()})
            number = {o: i for i, o in enumerate(owners)}
            own = np.array([number[rows[k][0]] for k in keys])
            texts = [rows[k][1].split(b" ") for k in keys]
            index = FMIndex(texts, own, window)
            least = index.matching(index.own_texts())[1]
            early = [ranges((w[: len(w) - window + 1] >= 0) & (w[: len(w) - window + 1] < o)) for w, o in zip(least, own, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), pa.array(early, span)], ["anchor", "context", "early"])

        def ranges(windows: np.ndarray) -> list[tuple[int, int]]:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], windows, [0])).astype(np.int8)))
            return [(int(a), int(b) + window - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]

        for batch in batches:
            for shard, anchor, context, owner, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != held:
                    if rows:
                        yield out()
                    held, rows = shard, {}
                rows[anchor, context] = (owner, words)
        if rows:
            yield out()

    return parts.repartition("shard").sortWithinPartitions("shard").select("shard", "anchor", "context", "owner", "words").mapInArrow(run, "anchor long, context binary, early array<struct<from: int, to: int>>")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """``(k_id, k_text, spans)``: for each document that repeats earlier ones, ranges of words ``[from, to)``."""
    keyed = docs.select(F.col(doc_id).alias("k_id"), F.xxhash64(text, F.length(text)).alias("k_text"), F.col(text).alias("text")).where(F.col("k_id").isNotNull() & F.col("text").isNotNull())
    found = _contexts(keyed, window, anchor)
    shared = _anchors(keyed, window, anchor).groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("anchor")
    shared = materialize(shared, "anchors")
    found = materialize(found.join(shared, "anchor").select(*found.columns), "contexts")

    def distinct(rows: DataFrame) -> DataFrame:
        """Each context once, at its least document."""
        return rows.groupBy("anchor", "context").agg(F.min(F.struct("k_id", "k_text", "at", "n")).alias("p")).select("anchor", "context", "p.*")

    once = materialize(distinct(found), "contexts-once")
    large = materialize(once.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > hot).select("anchor"), "anchors-large")
    if not large.isEmpty():
        finer = _finer(found.join(large, "anchor", "left_semi"), keyed, window)
        found = materialize(found.join(large, "anchor", "left_anti").select(*found.columns).unionByName(finer), "contexts-finer")
        once = materialize(distinct(found), "contexts-once")
    shards = max(1, -(-once.count() // SHARD_CONTEXTS))
    parts = _with_words(once, keyed, window).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    early = _searched(parts, window)
    owners = once.select("anchor", "context", F.col("k_id").alias("owner"))
    owners = materialize(owners.join(early, ["anchor", "context"], "left"), "contexts-judged")
    judged = found.join(owners, ["anchor", "context"])
    whole = F.array(F.struct(F.col("at").alias("from"), (F.col("at") + F.col("n") + F.lit(window - 1)).alias("to")))
    part = F.transform("early", lambda x: F.struct((F.col("at") + x["from"]).alias("from"), (F.col("at") + x["to"]).alias("to")))
    spans = judged.select("k_id", "k_text", F.explode(F.when(F.col("k_id") > F.col("owner"), whole).otherwise(part)).alias("span"))
    return spans.groupBy("k_id", "k_text").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``, the words left, joined by one space."""
    spans = materialize(repeated_spans(docs, doc_id, text, **how).withColumnsRenamed({"k_id": "_g", "k_text": "_h", "spans": "_s"}), "spans")
    new = ("n_words", "n_removed", "kept_text")
    rows = without(docs, *new).withColumn("_t", F.xxhash64(text, F.length(text)))
    rows = rows.join(spans, (F.col(doc_id) == F.col("_g")) & (F.col("_t") == F.col("_h")), "left").drop("_t", "_g", "_h")

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for t, s in zip(texts, spans, strict=True):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            keep = np.ones(len(words), bool)
            for x in s if s is not None else ():
                keep[x["from"] : x["to"]] = False
            kept = words if keep.all() else [w for w, k in zip(words, keep, strict=True) if k]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])

    return rows.withColumn("_c", cut(text, "_s")).select("*", "_c.*").drop("_c", "_s")


def op4_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50
), grams AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS g FROM starts
), least AS (
  SELECT g, min(doc_id) AS first FROM grams GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM grams JOIN least USING (g) WHERE first < doc_id
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w
), kept AS (
  SELECT each.doc_id, count(*) AS n_words, count(gone.k) AS n_removed,
         string_agg(word, ' ' ORDER BY each.k) FILTER (WHERE gone.k IS NULL) AS text
  FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.k = gone.k GROUP BY each.doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

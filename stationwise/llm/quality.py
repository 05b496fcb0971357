"""Quality rules: word and repetition counts, and compression bands.

A text's zstandard ratio (bytes before over bytes after) tells repetitive text (high) and noise (low) from prose.
The ratios of prose grow with the length, so the limits of whole texts are given at some lengths (``WHOLE_LIMITS``)
and lie on straight lines over the logarithm of the length between them.  Every text longer than a chunk is also judged
by fixed chunks of several sizes, each with limits of its own, so that a stretch of noise or of one repeated line inside
a text counts; the last chunk of each size ends where the text does and overlaps the one before it, so all bytes are
judged.  A text no longer than a chunk is one chunk, which the limits of whole texts judge.

The limits here are wide enough for prose of any kind.  ``fit_limits`` draws tighter ones around a corpus's own documents
that are labelled good; the query and the pipeline do so.

Null and empty texts have no words and are rejected; repeated rows are judged alike; columns that
clash with the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import table, without

#: (length in bytes, lowest ratio, highest ratio) of whole texts; beyond the ends the nearest counts.
WHOLE_LIMITS = (
    (64, 0.90, 1.80), (128, 1.05, 2.00), (256, 1.20, 2.30), (512, 1.35, 2.70), (1_024, 1.50, 3.30), (2_048, 1.70, 3.80), (4_096, 1.85, 4.20),
    (8_192, 1.95, 4.60), (16_384, 2.00, 5.00), (32_768, 2.05, 5.30), (65_536, 2.10, 5.60), (1 << 20, 2.10, 6.50),
)
#: (bytes, lowest ratio, highest ratio) of chunks, and the share of a text's chunks that may lie outside.
CHUNK_LIMITS = ((512, 1.28, 2.70), (1_024, 1.45, 3.40), (4_096, 1.75, 4.50))
CHUNK_SHARE = 0.2
#: ``fit_limits`` widens what it finds by this share, finds nothing from fewer texts of a length than this, and counts
#: ratios in so many steps to a doubling.
FIT_MARGIN, FIT_LEAST, FIT_STEPS = 0.05, 100, 1_024

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
_FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "whole_ratio": "double", "bad_chunk_share": "double", "base_failed": "boolean", "kept": "boolean",
}


@dataclass(frozen=True)
class Bands:
    whole: tuple = WHOLE_LIMITS
    chunks: tuple = CHUNK_LIMITS
    chunk_share: float = CHUNK_SHARE
    level: int = 3

    def limits(self, length: int) -> tuple[float, float]:
        """The lowest and highest ratio of a whole text."""
        at = np.log2([n for n, _, _ in self.whole])
        return tuple(float(np.interp(np.log2(max(1, length)), at, [w[k] for w in self.whole])) for k in (1, 2))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows whose word sequence occurs twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    seq = (seq + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    seq ^= seq >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0xD6E8FEB86659FD93) + seq[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def chunk_ratios(raw: bytes, size: int, compressor) -> list[float]:
    """The ratios of a text's chunks, the last one ending where the text does; none if it is no longer than one."""
    last = len(raw) - size
    return [size / len(compressor.compress(raw[i : i + size])) for i in (*range(0, last, size), last)] if last > 0 else []


def band_verdict(raw: bytes, bands: Bands, compressor) -> tuple[float, float, bool]:
    """The whole text's ratio, the largest share of chunks outside their band, and whether it passes."""
    ratio = len(raw) / len(compressor.compress(raw))
    low, high = bands.limits(len(raw))
    share = 0.0
    for size, least, most in bands.chunks:
        if ratios := chunk_ratios(raw, size, compressor):
            share = max(share, sum(not least <= r <= most for r in ratios) / len(ratios))
    return ratio, share, low <= ratio <= high and share <= bands.chunk_share


def measure(text: str | None, bands: Bands, compressor) -> tuple:
    if not text:
        return 0, 0, 0, 0, 0, 0.0, 0.0, True, False
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    ratio, share, fits = band_verdict(raw, bands, compressor)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (
        len(words), chars, sum(raw.count(bytes([c])) for c in SYMBOLS), duplicate_lines(raw), repeat,
        ratio, share, failed, fits and not failed,
    )


def quality_column(text: str | Column = "text", bands: Bands = Bands()) -> Column:
    """A struct of the counts, the ratios and the verdict."""

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in _FIELDS.items()))
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        for texts in batches:
            yield pd.DataFrame([measure(t, bands, compressor) for t in texts], columns=list(_FIELDS))

    return rules(F.col(text) if isinstance(text, str) else text)


def quality_rules(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """``docs`` with the measures and ``kept``; no row is dropped."""
    out = without(docs, *[c for c in _FIELDS if c != text]).withColumn("_q", quality_column(text, bands))
    return out.select("*", "_q.*").drop("_q")


def keep_good(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with their own columns."""
    return docs.withColumn("_q", quality_column(text, bands)).where("_q.kept").drop("_q")


def fit_limits(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", margin: float = FIT_MARGIN, least: int = FIT_LEAST) -> Bands:
    """Bands around the labelled documents of good quality: the 1st and 99th percentile by length, widened by ``margin``.

    Lengths are sorted by doublings; one with fewer than ``least`` texts keeps the wide limits, as does a size of chunks that
    fewer texts have.  Chunk limits hold the least and the largest chunk of 99 % of the texts.  All labelled documents count:
    ratios are taken where the texts are read, and only they meet the labels; texts are not shuffled.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_l")).distinct()
    sizes = [size for size, _, _ in CHUNK_LIMITS]

    @F.pandas_udf("array<struct<size: int, length: int, low: double, high: double>>")
    def ratios(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=3, write_content_size=False)
        for texts in batches:
            out = []
            for raw in (t.encode("utf-8", "surrogatepass") for t in texts):
                whole = len(raw) / len(compressor.compress(raw))
                found = [(0, 1 << max(6, round(np.log2(len(raw)))), whole, whole)]
                found += [(size, size, min(r), max(r)) for size in sizes if (r := chunk_ratios(raw, size, compressor))]
                out.append([dict(zip(("size", "length", "low", "high"), f, strict=True)) for f in found])
            yield pd.Series(out)

    taken = docs.where(F.length(text) > 0).select(F.col(doc_id).alias("_d"), ratios(text).alias("_r"))
    found = taken.join(good, F.col("_d") == F.col("_l")).select(F.inline("_r"))
    step = lambda c: F.round(F.log2(c) * FIT_STEPS).cast("int")
    ends = F.inline(F.array(*[F.struct(F.lit(c == "high").alias("upper"), step(c).alias("step")) for c in ("low", "high")]))
    counts = found.select("size", "length", ends).groupBy("size", "length", "upper", "step").count()  # bounded, however many texts there are
    edge = lambda upper, share: F.percentile(F.when(F.col("upper") == upper, F.col("step")), share, F.col("count"))
    # at most a row for each doubling and chunk size
    limits = (
        counts.groupBy("size", "length").agg(F.sum(F.when(F.col("upper"), F.col("count"))).alias("n"), edge(False, 0.01).alias("low"), edge(True, 0.99).alias("high"))
        .where(F.col("n") >= least).select("size", "length", *[F.pow(F.lit(2.0), F.col(c) / FIT_STEPS).alias(c) for c in ("low", "high")]).collect()
    )
    fitted = {(r["size"], r.length): (r.low * (1 - margin), r.high * (1 + margin)) for r in limits}
    wide = {(0, n): (low, high) for n, low, high in WHOLE_LIMITS} | {(n, n): (low, high) for n, low, high in CHUNK_LIMITS}
    both = sorted((wide | fitted).items())
    return Bands(tuple((n, *x) for (size, n), x in both if not size), tuple((n, *x) for (size, n), x in both if size))


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, bands=fit_limits(docs, table(spark, sf_dir, "labels"))).drop("text")

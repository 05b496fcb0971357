"""Phrase collocation mining by Rabin-Karp fingerprints.

Texts become blocks of words.  A prefix polynomial over the bytes of a block gives the hash of every word, and a second
one over the words' hashes the fingerprint of every n-gram: each is a difference of two prefix values times a power, for all
n-grams at once in numpy, modulo 2 to the 64th, finished by a mixer.  A fingerprint stands for a language, a length and words.

Scans go by length.  Each sums a block's occurrences by fingerprint, with a pointer to the first document that holds it,
and the shuffle adds the sums up.  An n-gram cannot be frequent unless the n-grams within it are, so a
scan passes over those whose parts are not marked in a table of bits that the scan before left; that table's size
follows the number of frequent fingerprints, checked, up to ``MARK_BYTES``, beyond which more n-grams are counted in vain and none is missed.

Fingerprints that collide only add up to too much, so all frequent phrases are among the frequent fingerprints.  A last scan
counts by text: within a block, each word's bytes are compared with those of the first word of its hash, and each n-gram's words with
those of its fingerprint's first occurrence; where any differ the block is counted by the words themselves.  Phrases are cut from
the text there, for marked fingerprints only, and carry a pointer to a document and a word of it.
So the counts of phrases are exact whatever collides.

Defined results: null and empty texts have no words; a null language is ``und``; rows that repeat an id or all of a row
count each; ties go by count, then by the phrase's bytes; columns beyond those named are ignored, and an empty table gives an
empty result.  A text of any length is one block at least.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.llm.common import copied_if_small, materialize, table
from stationwise.llm.hashing import mix

LONGEST, MIN_COUNT, TOP, COVER_PERCENT = 3, 10, 2_000, 50
#: Bytes of text in a block, of which so many go through the polynomial at a time, and rows of a batch that a task sends.
BLOCK_BYTES, PREFIX_BYTES, BATCH_ROWS = 4 << 20, 512 << 10, 100_000
#: Bits for each frequent fingerprint, and the most bytes of a table of bits.
MARK_BITS, MARK_BYTES = 16, 32 << 20
SALTS = 64
#: Odd factors of the two polynomials: of bytes and of words.
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What a byte is: 0 part of a word, 1 white space, 2 the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
#: Bits of a fingerprint.
BITS = 64


class Polynomial:
    """Hashes of ranges of a sequence: ``sum(value[i] * factor ** (end - i))`` modulo 2 to the 64th."""

    def __init__(self, factor: int):
        self.factor, self.inverse = np.uint64(factor), np.uint64(pow(factor, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def of(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(values):
            n = len(values) + len(values) // 4 + 1
            self.powers, self.inverses = (np.cumprod(np.append(np.uint64(1), np.full(n, f, np.uint64)), dtype=np.uint64) for f in (self.factor, self.inverse))
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.inverses[: len(values)], dtype=np.uint64, out=prefix[1:])
        return (prefix[ends] - prefix[starts]) * self.powers[ends]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least place of each distinct key, how often it is there, and which of them each place has."""
    order = np.argsort(keys)
    held = keys[order]
    opens = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(keys) else order
    of = np.empty(len(keys), np.int64)
    of[order] = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(keys))))
    return np.minimum.reduceat(order, opens) if len(keys) else order, np.diff(np.append(opens, len(keys))), of


@dataclass
class Block:
    """Lower-cased texts, where their words lie, of which documents and languages they are, and the words' hashes."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    entry: np.ndarray
    hashes: np.ndarray
    docs: list
    bases: np.ndarray
    langs: np.ndarray
    names: list
    seeds: np.ndarray

    def grams(self, n: int) -> np.ndarray:
        """The places of all n-grams within pieces."""
        m = max(0, len(self.starts) - n + 1)
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1 : n - 1 + m])

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The words of the n-grams at ``at``, joined by one space."""
        words = (at[:, None] + np.arange(n)).ravel()
        sizes = self.ends[words] - self.starts[words] + 1
        raw = np.empty(int(sizes.sum()), np.uint8)
        stops = np.cumsum(sizes)
        inside = np.ones(len(raw), bool)
        inside[stops - 1] = False
        raw[~inside] = 0x20
        raw[inside] = self.text[_ranges(self.starts[words], sizes - 1)]
        offsets = np.append(0, stops[n - 1 :: n]).astype(np.int64)  # each phrase ends in a space too many
        inside[:] = True
        inside[offsets[1:] - 1] = False
        offsets -= np.arange(len(offsets))
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[inside])])

    def lang(self, at: np.ndarray) -> np.ndarray:
        return self.langs[self.entry[at]]

    def pointers(self, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The document and the number of the word in it."""
        entry = self.entry[at]
        opening = np.searchsorted(self.entry, np.arange(len(self.docs)))
        return pa.array(self.docs, pa.int64()).take(pa.array(entry)), pa.array(at - opening[entry] + self.bases[entry])

    def same_words(self, at: np.ndarray, like: np.ndarray) -> bool:
        """Whether the words at ``at`` have the bytes of those at ``like``."""
        size = self.ends[at] - self.starts[at]
        if (size != self.ends[like] - self.starts[like]).any():
            return False
        step = 1 << 17
        return all((self.text[_ranges(self.starts[at[k : k + step]], size[k : k + step])] == self.text[_ranges(self.starts[like[k : k + step]], size[k : k + step])]).all() for k in range(0, len(at), step))

    def exact_words(self) -> np.ndarray:
        """A number for each word, the same for words of the same bytes and no others."""
        first, _, of = _first_of(self.hashes)
        every = np.arange(len(self.starts))
        if self.same_words(every, first[of]):
            return of
        known: dict[bytes, int] = {}  # hashes collide here
        raw = self.text.tobytes()
        return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)], np.int64)


class Fingerprints:
    """The two polynomials, whose powers are kept from block to block; fewer ``bits`` collide more."""

    def __init__(self, bits: int = BITS):
        self.of_bytes, self.of_words, self.shift = Polynomial(_BYTE), Polynomial(_WORD), np.uint64(64 - bits)

    def block(self, entries: list[tuple]) -> Block:
        """From ``(no id, id, words before, language, text)``; the first of equal n-grams has the least pointer."""
        import xxhash

        entries = sorted(entries, key=lambda e: e[:3])
        known: dict[str, int] = {}
        langs = np.array([known.setdefault(e[3], len(known)) for e in entries])
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in known], np.uint64)
        raw = np.frombuffer(b"\n".join(e[4] for e in entries).translate(_LOWER), np.uint8)
        starts, ends = _words(raw)
        piece = np.cumsum(_KIND[raw] == 2, dtype=np.int32)[starts] if len(starts) else starts
        entry = np.searchsorted(np.cumsum([0, *(len(e[4]) + 1 for e in entries)]), starts, "right") - 1
        hashes, cuts = np.empty(len(starts), np.uint64), [0, *(np.searchsorted(starts, np.arange(PREFIX_BYTES, len(raw), PREFIX_BYTES))).tolist(), len(starts)]
        for a, b in zip(cuts, cuts[1:], strict=False):  # prefixes of some of the bytes at a time
            if a < b:
                hashes[a:b] = mix(self.of_bytes.of(_LETTERS[raw[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], ends[a:b] - starts[a])) >> self.shift
        return Block(raw, starts, ends, piece, entry, hashes, [None if e[0] else e[1] for e in entries], np.array([e[2] for e in entries]), langs, list(known), seeds)

    def grams(self, block: Block, n: int, at: np.ndarray) -> np.ndarray:
        """The fingerprints of the n-grams at ``at``."""
        h = self.of_words.of(block.hashes, at, at + n)
        return mix((h ^ block.seeds[block.lang(at)]) + np.uint64(n)) >> self.shift


def _slots(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    other = mix(prints + np.uint64(_BYTE))
    return (mix(prints) & np.uint64(bits - 1)).astype(np.int64), (other & np.uint64(bits - 1)).astype(np.int64)


def marked(table: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether both bits of each fingerprint are set."""
    bits, out = len(table) * 8, np.ones(len(prints), bool)
    for at in _slots(prints, bits):
        out &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def marks(prints: DataFrame) -> np.ndarray:
    """A table of bits of ``prints(fp)``, materialized; its parts are set in tasks and put together on the driver."""
    bits = 1 << min((MARK_BYTES * 8).bit_length() - 1, max(16, (max(1, prints.count()) * MARK_BITS - 1).bit_length()))
    part = min(bits // 8, 1 << 16)  # bytes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_slots(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // (part * 8)), pa.array(at % (part * 8))], ["part", "bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(part * 8, bool))
        for batch in batches:
            of, bit = (c.to_numpy() for c in batch.columns)
            for p in np.unique(of):
                parts[p][bit[of == p]] = True
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in parts.values()], pa.binary())], ["part", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    placed = prints.select("fp").mapInArrow(place, "part long, bit long").repartition("part")
    for r in placed.mapInArrow(fill, "part long, bits binary").toLocalIterator():  # at most MARK_BYTES, whatever the input
        out[r.part * part : (r.part + 1) * part] |= np.frombuffer(r.bits, np.uint8)
    return out


def _rows(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate(([1], _KIND[raw] != 0, [1])).astype(np.int8)))
    return edges[::2], edges[1::2]


def _parts(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """The text, cut behind ends of pieces if it is longer than a block, and the words before each part."""
    at = base = 0
    if len(raw) > BLOCK_BYTES:
        codes = np.frombuffer(raw, np.uint8)
        ends = np.flatnonzero(_KIND[codes] == 2) + 1
        while len(raw) - at > BLOCK_BYTES and (k := np.searchsorted(ends, at + BLOCK_BYTES)) < len(ends):
            yield raw[at : ends[k]], base
            base += len(_words(codes[at : ends[k]])[0])
            at = int(ends[k])
    yield raw[at:], base


def _blocks(batches: Iterator[pa.RecordBatch], prints: Fingerprints) -> Iterator[Block]:
    """Blocks of about ``BLOCK_BYTES``, by document within each."""
    entries, size = [], 0
    for batch in batches:
        for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for raw, base in _parts(text.encode("utf-8", "surrogatepass")):
                if entries and size + len(raw) > BLOCK_BYTES:
                    yield prints.block(entries)
                    entries, size = [], 0
                entries.append((doc is None, doc or 0, base, lang, raw))
                size += len(raw)
    if entries:
        yield prints.block(entries)


_COUNTED = ["lang", "fp", "f", "doc"]


def counted(docs: DataFrame, n: int, parts: np.ndarray | None, bits: int = BITS) -> DataFrame:
    """``(lang, fp, f, doc)``: fingerprints of n-grams, occurrences, and the least document with one; the language is in the fingerprint.

    For words, a row of each language without a fingerprint counts all of them.
    With ``parts``, a table of bits, n-grams with a part of ``n - 1`` words that is not marked are passed over.
    """
    shipped = None if parts is None else docs.sparkSession.sparkContext.broadcast(parts)  # at most MARK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(bits)
        for block in _blocks(batches, prints):
            at = block.grams(n)
            if shipped is not None:
                inner, good = block.grams(n - 1), np.zeros(len(block.starts) + 1, bool)
                good[inner[marked(shipped.value, prints.grams(block, n - 1, inner))]] = True
                at = at[good[at] & good[at + 1]]
            if not at.size:
                continue
            if n == 1:
                words = np.bincount(block.lang(at), minlength=len(block.names))
                none = pa.nulls(len(words), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(block.names, pa.string()), none, pa.array(words), none], _COUNTED)
            fp = prints.grams(block, n, at)
            first, f, _ = _first_of(fp)
            for k in range(0, len(first), BATCH_ROWS):
                some = first[k : k + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.array(fp[some].view(np.int64)), pa.array(f[k : k + BATCH_ROWS]), block.pointers(at[some])[0]], _COUNTED)

    rows = docs.mapInArrow(run, "lang string, fp long, f long, doc long")
    sums = [F.sum("f").alias("f"), F.min("doc").alias("doc")]  # numbers alone, so that Spark adds up by hashes
    return (rows.groupBy("lang", "fp").agg(*sums) if n == 1 else rows.groupBy("fp").agg(*sums).withColumn("lang", F.lit(None).cast("string"))).select(*_COUNTED)


def verified(docs: DataFrame, prints: list[np.ndarray], longest: int, bits: int = BITS) -> DataFrame:
    """``(lang, size, phrase, f, doc, word)``: exact counts of the phrases whose fingerprints are marked, and of some others."""
    shipped = docs.sparkSession.sparkContext.broadcast(prints)  # at most ``longest`` times MARK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, fingerprints = shipped.value, Fingerprints(bits)
        for block in _blocks(batches, fingerprints):
            word = block.exact_words()
            for n in range(1, longest + 1):
                at = block.grams(n)
                fp = fingerprints.grams(block, n, at)
                kept = marked(tables[n - 1], fp)
                at, fp = at[kept], fp[kept]
                first, f, of = _first_of(fp)
                like, lang = at[first][of], block.lang(at)
                if any((word[at + k] != word[like + k]).any() for k in range(n)) or (lang != lang[first][of]).any():  # fingerprints collide here
                    own: dict[tuple, int] = {}
                    first, f, _ = _first_of(np.array([own.setdefault(x, len(own)) for x in zip(lang.tolist(), *(word[at + k].tolist() for k in range(n)), strict=True)], np.int64))
                for k in range(0, len(first), BATCH_ROWS):
                    places = at[first[k : k + BATCH_ROWS]]
                    names = pa.array(block.names, pa.string()).take(pa.array(block.lang(places)))
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(places), n, np.int32)), block.phrases(places, n), pa.array(f[k : k + BATCH_ROWS]), *block.pointers(places)], ["lang", "size", "phrase", "f", "doc", "word"])

    rows = docs.mapInArrow(run, "lang string, size int, phrase binary, f long, doc long, word long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"), F.min("doc").alias("doc"), F.min_by("word", "doc").alias("word"))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """``(lang, size, phrase, f, doc, word)`` of all phrases of up to ``longest`` words that occur so often, and ``(lang, n)``, all words."""
    docs, tables, words = _rows(docs, doc_id, text, lang), [], None
    for n in range(1, longest + 1):
        prints = counted(docs, n, tables[-1] if tables else None, bits)
        often = materialize(prints.where((F.col("f") >= min_count) | F.col("fp").isNull()), f"often-{n}")
        if n == 1:
            words = often.where("fp IS NULL").select("lang", F.col("f").alias("n"))
        tables.append(marks(often.where("fp IS NOT NULL")))
    exact = verified(docs, tables, longest, bits).where(F.col("f") >= min_count)
    return materialize(exact, "phrases"), words


def collocations(phrases: DataFrame, words: DataFrame, top: int = TOP, cover: int = COVER_PERCENT) -> DataFrame:
    """The first ``top`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score, first_doc, first_word)``."""
    tokens = F.split(F.col("phrase").cast("string"), " ")
    counts = phrases.select(F.col("lang").alias("_c"), F.col("phrase").alias("_p"), F.col("f").alias("_f"))
    counts = copied_if_small(counts, 96)
    candidates = phrases.where("size > 1").withColumnRenamed("f", "a").withColumn("_w", tokens)

    def looked_up(df: DataFrame, key: Column, name: str) -> DataFrame:
        found = counts.withColumnRenamed("_f", name)
        return df.join(found, (F.col("lang") == F.col("_c")) & (key == F.col("_p"))).drop("_c", "_p")

    part = lambda a, b: F.array_join(F.slice("_w", a, b), " ").cast("binary")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = looked_up(cuts.withColumns({"_left": part(F.lit(1), F.col("k")), "_right": part(F.col("k") + 1, F.col("size") - F.col("k"))}), F.col("_left"), "l")
    cuts = looked_up(cuts, F.col("_right"), "r")
    # decimals hold 38 digits: a below 10 ** 16, l and r below 10 ** 19; ``div`` of whole decimals is exact
    score = F.expr("CAST(CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a", "doc", "word").agg(F.min(F.struct("score", "k", "l", "r")).alias("_s"))
    # what a longer candidate with enough of the occurrences holds goes
    inner = F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> CAST(array_join(slice(_w, i, s), ' ') AS BINARY))))")
    inside = candidates.where("size > 2").select(F.col("lang").alias("_l"), F.col("a").alias("_a"), F.explode(inner).alias("_i"))
    most = inside.groupBy("_l", "_i").agg(F.max("_a").alias("_m"))
    scored = scored.join(most, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_i")) & (100 * F.col("_m") >= cover * F.col("a")), "left_anti")
    rows = scored.select("lang", F.col("phrase").cast("string"), "phrase", "a", "doc", "word", F.col("_s.l").alias("l"), F.col("_s.r").alias("r"), F.col("_s.score").alias("score")).toDF("lang", "phrase", "_p", "a", "first_doc", "first_word", "l", "r", "score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("_p").asc()]
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best)).cast("long")
    # a task sees at most ``top`` rows of each salt
    some = rows.withColumn("_salt", F.pmod(F.xxhash64("_p"), F.lit(SALTS))).withColumn("_k", first("lang", "_salt")).where(F.col("_k") <= top)
    ranked = some.withColumn("rank", first("lang")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first_doc", "first_word")


def op11_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(*frequent_phrases(table(spark, sf_dir, "documents"))).drop("first_doc", "first_word")


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY lang, size, phrase HAVING count(*) >= 10
), c AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), cuts AS (
  SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM c
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, x.f AS l, y.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
              JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE size = 3
), kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * longer >= 50 * s.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000
"""

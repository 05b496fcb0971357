"""Byte-level BPE encoding and decoding with a lexicon: a minimal acyclic transducer of frequent words.

The pre-tokenizer's words are counted over the whole corpus, and those above the count that leaves at most ``most`` of
them are merged once, in tasks, and compiled into an automaton whose equal suffixes are shared.  Its edges carry numbers
whose sum along a word's path is the word's place, and the places point to the words' ids.  The compiled file goes to
the shared folder and from there to each executor once (``SparkContext.addFile``); the Python workers of a machine map
the same pages into memory.  A block's distinct words walk through the automaton together, a byte at a step; words
it does not hold are merged exactly, by the vocabulary's ranks, the leftmost of equal ranks first.  The lexicon
only saves work: ids are the same with any lexicon or none.

Decoding concatenates the bytes of the ids' tokens; bytes that are not UTF-8 become replacement characters.

Which characters are letters and numbers depends on the Unicode version of the tokenizers library, so characters that are
newer than Python's own tables are asked of it once, on the driver.

Defined results: a null or empty text has no ids and decodes to the empty string, null ids decode to it too, and null in a
list of ids is passed over; a special token's string in a text is that token; a text is cut into blocks only where a word surely ends, so its length
does not matter; repeated rows are encoded alike; columns named ``ids`` and ``decoded`` are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from stationwise.llm.common import materialize, table, table_path, without

#: The lexicon holds at most so many words, of at most so many bytes.
LEXICON_WORDS, LEXICON_BYTES = 1 << 17, 48
#: Texts are worked on in blocks of about so many characters.
BLOCK_CHARS = 1 << 20
_SHORT = 48


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: visible ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _ranges_of(codes: list[int]) -> str:
    if not codes:
        return ""
    at = np.array(codes, np.int64)
    cuts = np.flatnonzero(np.diff(at) > 1)
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(at[np.append(0, cuts + 1)], at[np.append(cuts, at.size - 1)], strict=True))


#: The pre-tokenizer's pattern in the standard library's classes, which are faster and differ in few characters.
_PLAIN = r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class WordPattern:
    """The pre-tokenizer's pattern, and a class with all characters for which the plain one does not do."""

    full: str
    odd: str

    def finder(self):
        plain, odd, full = re.compile(_PLAIN).findall, re.compile(self.odd).search, regex.compile(self.full).findall
        return lambda text: full(text) if odd(text) else plain(text)


@cache
def word_pattern() -> WordPattern:
    """The pattern with the letters and numbers that the tokenizers library knows."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    newer = "".join(c for c in every if unicodedata.category(c) == "Cn")
    classes = {}
    for kind, like in (("L", "a"), ("N", "1")):
        gone = [ord(c) for c in regex.findall(rf"\p{{{kind}}}", newer) if len(split(like + c)) > 1]
        classes[kind] = rf"[\p{{{kind}}}--[{_ranges_of(gone)}]]" if gone else rf"\p{{{kind}}}"
    letters, numbers = classes["L"], classes["N"]
    odd = set()
    for own, plain in ((letters, r"[^\W\d_]"), (numbers, r"\d"), (r"\s", r"\s")):
        odd |= set(regex.findall(f"(?V1){own}", every)) ^ set(re.findall(plain, every))
    full = rf"(?V1)'(?:[stmd]|re|ve|ll)| ?{letters}+| ?{numbers}+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"
    return WordPattern(full, f"[{_ranges_of(sorted(ord(c) for c in odd if c < '\U00010000'))}\U00010000-\U0010ffff]")  # one range beyond: a class of many is slow there


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary: pairs' ranks, the ids that pairs of a rank merge to, tokens' bytes, special tokens."""

    byte_ids: list
    ranks: dict
    results: list
    keys: np.ndarray
    key_ranks: np.ndarray
    byte_ranks: np.ndarray
    pieces: list
    special: dict

    @staticmethod
    @lru_cache(2)
    def of(content: bytes) -> Vocabulary:
        data, letters = json.loads(content), byte_letters()
        ids = data["model"]["vocab"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        pieces = [b""] * (1 + max(*ids.values(), *special.values(), 0))
        for token, k in ids.items():
            pieces[k] = bytes(letters[c] for c in token)
        for token, k in special.items():
            pieces[k] = token.encode()
        merges = data["model"]["merges"]
        ranks = {(ids[a] << 32) | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        byte_ids = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        keys = np.array(sorted(ranks), np.int64)
        byte_ranks = np.array([[ranks.get((a << 32) | b, len(merges)) for b in byte_ids] for a in byte_ids], np.int32)
        return Vocabulary(byte_ids, ranks, [ids[a + b] for a, b in merges], keys, np.array([ranks[k] for k in keys.tolist()], np.int32), byte_ranks, pieces, special)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; as many as there are merges where two ids do not merge."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else None
        return np.where(self.keys[at] == key, self.key_ranks[at], len(self.results)) if at is not None else np.zeros(len(key), np.int32)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The words' ids, exactly."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((1, 8), (9, 16), (17, _SHORT)):
            some = np.flatnonzero((sizes >= low) & (sizes <= high))
            for k in range(0, len(some), 1 << 15):
                at = some[k : k + (1 << 15)].tolist()
                for i, ids in zip(at, self._merge_short([words[i] for i in at], sizes[at]), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > _SHORT).tolist():
            out[i] = self._merge_long(words[i])
        return out

    def _merge_short(self, words: list[bytes], sizes: np.ndarray) -> list[list[int]]:
        """All words take one merge at a time: each the leftmost of its pairs with the least rank."""
        width, none = int(sizes.max()), len(self.results)
        there = np.arange(width) < sizes[:, None]
        raw = np.zeros((len(words), width), np.uint8)
        raw[there] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(there, np.array(self.byte_ids, np.int32)[raw], -1)
        rank = np.full((len(words), width), none, np.int32)
        rank[:, :-1] = np.where(there[:, 1:], self.byte_ranks[raw[:, :-1], raw[:, 1:]], none)
        results, own, left = np.array([*self.results, 0], np.int32), np.arange(len(words)), sizes.copy()
        done: list[tuple[np.ndarray, np.ndarray]] = []
        column = np.arange(width)
        while True:
            best = rank.argmin(1)
            least = rank[np.arange(len(best)), best]
            on = least < none
            if not on.all():
                done.append((own[~on], ids[~on]))
                ids, rank, own, best, least = (x[on] for x in (ids, rank, own, best, least))
            if not len(own):
                break
            row, after = np.arange(len(own)), column > best[:, None]
            new = results[least]
            ids[:, :-1] = np.where(after[:, :-1], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = np.where(after[:, -1], -1, ids[:, -1])
            rank[:, :-1] = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = none
            ids[row, best] = new
            for a in (best - 1, best):  # the pairs on both sides of the new id
                known = np.flatnonzero((a >= 0) & (a + 1 < width))
                at, l, r = a[known], ids[known, a[known]], ids[known, np.minimum(a[known] + 1, width - 1)]  # noqa: E741
                rank[known, at] = np.where(r >= 0, self._ranks_of(l, np.maximum(r, 0)), none)
            rank[row[best == width - 1], width - 1] = none
            left[own] -= 1
        out: list[list[int]] = [[]] * len(words)
        for places, rows in done:
            for i, n, x in zip(places.tolist(), left[places].tolist(), rows.tolist(), strict=True):
                out[i] = x[:n]
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """As ``merge``, by a heap of pairs over linked symbols: its cost grows with the length times its logarithm."""
        n = len(word)
        ids, after, before = [self.byte_ids[b] for b in word], [*range(1, n), -1], [*range(-1, n - 1)]
        rank_of = lambda a, b: self.ranks.get((ids[a] << 32) | ids[b])
        heap = [(rank, k) for k in range(n - 1) if (rank := rank_of(k, k + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if ids[k] < 0 or (right := after[k]) < 0 or rank_of(k, right) != rank:
                continue
            ids[k], ids[right], after[k] = self.results[rank], -1, after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if min(a, b) >= 0 and (rank := rank_of(a, b)) is not None:
                    heapq.heappush(heap, (rank, a))
        return [i for i in ids if i >= 0]


class Lexicon:
    """A minimal acyclic transducer from words to ids, as arrays in one piece of memory.

    ``edges`` are ``state << 8 | byte``, sorted; an edge leads to a state and adds a number.  The sum over a word's
    edges is its place among the words, and ``starts`` has where the ids of each place begin.
    """

    _PARTS = (("edges", np.int64), ("to", np.int32), ("adds", np.int32), ("final", np.uint8), ("starts", np.int32), ("ids", np.int32))

    def __init__(self, blob):
        sizes, at = np.frombuffer(blob, np.int64, 2 + len(self._PARTS)), 8 * (2 + len(self._PARTS))
        self.root, self.longest = int(sizes[0]), int(sizes[1])
        for (name, kind), n in zip(self._PARTS, sizes[2:], strict=True):
            setattr(self, name, np.frombuffer(blob, kind, int(n), at))
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def compiled(cls, entries: dict[bytes, list[int]]) -> bytes:
        """From words and their ids: states are frozen as soon as the sorted words leave them, equal ones once."""
        words = sorted(w for w in entries if w)
        register: dict[tuple, int] = {}
        holds: list[int] = []  # words that end at or below a frozen state

        def freeze(final: bool, edges: list) -> int:
            key = (final, *edges)
            if (state := register.get(key)) is None:
                state = register[key] = len(holds)
                holds.append(final + sum(holds[to] for _, to in edges))
            return state

        path, last = [[False, []]], b""  # the open states along the last word
        for word in words:
            same = 0
            while same < len(last) and last[same] == word[same]:
                same += 1
            while len(path) > same + 1:
                done = path.pop()
                path[-1][1].append((last[len(path) - 1], freeze(*done)))
            path += [[False, []] for _ in word[same:]]
            path[-1][0], last = True, word
        while len(path) > 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(*done)))
        root = freeze(*path[0])
        edges, to, adds, final = [], [], [], np.zeros(len(holds), np.uint8)
        for (ends, *out), state in register.items():
            final[state], before = ends, int(ends)
            for byte, target in out:
                edges.append(state << 8 | byte)
                to.append(target)
                adds.append(before)
                before += holds[target]
        ids = [entries[w] for w in words]
        parts = (edges, to, adds, final, np.cumsum([0, *map(len, ids)]), [i for x in ids for i in x])
        order = np.argsort(np.array(edges, np.int64), kind="stable")
        arrays = [np.asarray(p, kind) for p, (_, kind) in zip(parts, cls._PARTS, strict=True)]
        arrays[:3] = [a[order] for a in arrays[:3]]
        head = np.array([root, max(map(len, words), default=0), *map(len, arrays)], np.int64).tobytes()
        return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, -1 where the lexicon does not hold it; all words take a step at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        place = np.full(len(words), -1, np.int64)
        if not len(self.edges) or not len(words):
            return place
        text, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        on = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        state, total = np.full(len(on), self.root, np.int64), np.zeros(len(on), np.int64)
        step = 0
        while on.size:
            ends = lengths[on] == step
            if ends.any():
                out = np.flatnonzero(ends)
                full = out[self.final[state[out]] > 0]
                place[on[full]] = total[full]
                on, state, total = on[~ends], state[~ends], total[~ends]
            edge = state << 8 | text[begin[on] + step]
            at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            found = self.edges[at] == edge
            on, at = on[found], at[found]
            state, total = self.to[at].astype(np.int64), total[found] + self.adds[at]
            step += 1
        return place


def _pieces(text: str) -> Iterator[str]:
    """The text in blocks; they end before a single space between two other characters, where a word surely ends."""
    at, cut = 0, regex.compile(r"(?<=\S) (?=\S)")
    while len(text) - at > 2 * BLOCK_CHARS and (m := cut.search(text, at + BLOCK_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _words(text: str, find, special: dict) -> Iterator[list]:
    """Lists of words; a special token is a list with its id."""
    if not special:
        yield from map(find, _pieces(text))
        return
    for part in regex.split("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")", text) if any(s in text for s in special) else [text]:
        if part in special:
            yield [special[part]]
        elif part:
            yield from map(find, _pieces(part))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


class _Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, pattern: WordPattern):
        self.vocabulary, self.lexicon, self.find = vocabulary, lexicon, pattern.finder()

    def _block(self, lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all lists one after the other, and how many each has."""
        numbers = _Numbers()
        local = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
        distinct = [w.encode("utf-8", "surrogatepass") if isinstance(w, str) else b"" for w in numbers]
        place = self.lexicon.places(distinct)
        extra, size = [], len(self.lexicon.ids)
        begin, length = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        held = place >= 0
        begin[held], length[held] = self.lexicon.starts[place[held]], np.diff(self.lexicon.starts)[place[held]]
        words, rare = list(numbers), np.flatnonzero(~held).tolist()
        for k, ids in zip(rare, self.vocabulary.merge([distinct[k] for k in rare]), strict=True):
            ids = ids if isinstance(words[k], str) else [words[k]]
            begin[k], length[k] = size + len(extra), len(ids)
            extra += ids
        ids = np.append(self.lexicon.ids, np.array(extra, np.int32))
        counts = length[local]
        ends = np.cumsum([0, *map(len, lists)])
        total = np.append(0, np.cumsum(counts))
        return ids[_ranges(begin[local], counts)], np.diff(total[ends])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        lists, of, held, done = [], [], 0, []
        counts = np.zeros(len(texts), np.int64)

        def flush() -> None:
            nonlocal held
            if lists:
                ids, sizes = self._block(lists)
                np.add.at(counts, of, sizes)
                done.append(ids)
            lists.clear()
            of.clear()
            held = 0

        for k, text in enumerate(texts):
            for words in _words(text or "", self.find, self.vocabulary.special):
                lists.append(words)
                of.append(k)
                held += sum(map(len, words)) if not words or isinstance(words[0], str) else 1
                if held >= BLOCK_CHARS:
                    flush()
        flush()
        return np.concatenate(done) if done else np.zeros(0, np.int32), counts


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        lengths = np.fromiter(map(len, vocabulary.pieces), np.int64, len(vocabulary.pieces))
        self.bytes, self.lengths, self.begin = np.frombuffer(b"".join(vocabulary.pieces), np.uint8), lengths, np.cumsum(lengths) - lengths

    def decode(self, ids: np.ndarray) -> str:
        out, step = [], BLOCK_CHARS
        for at in range(0, len(ids), step):
            some = ids[at : at + step]
            out.append(self.bytes[_ranges(self.begin[some], self.lengths[some])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def _word_counts(docs: DataFrame, text: str, pattern: WordPattern, special: dict) -> DataFrame:
    """``(word, n)`` of words that are short enough for a lexicon; several rows a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = pattern.finder(), Counter()

        def rows() -> pa.RecordBatch:
            kept = {b: n for w, n in seen.items() if len(b := w.encode("utf-8", "surrogatepass")) <= LEXICON_BYTES}
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.binary()), pa.array(kept.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in _words(text or "", find, special):
                    if words and isinstance(words[0], str):
                        seen.update(words)
                    if len(seen) > 400_000:
                        yield rows()
        if seen:
            yield rows()

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "word binary, n long")


def build_lexicon(docs: DataFrame, content: bytes, text: str = "text", most: int = LEXICON_WORDS) -> bytes:
    """A compiled lexicon of the most frequent words of all texts; ``most`` bounds what reaches the driver.

    Counts are cut at a value, sixteen to a doubling; words with counts below it are left to exact merging.
    """
    spark, pattern = docs.sparkSession, word_pattern()
    counts = _word_counts(docs, text, pattern, Vocabulary.of(content).special).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = counts.withColumn("level", F.floor(16 * F.log2("n")).cast("int"))
    counts = materialize(counts, "words")
    level, held = None, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):  # a row for each sixteenth of a doubling
        held += r["count"]
        if held > most:
            break
        level = r.level
    if level is None:
        return Lexicon.compiled({})
    shipped = spark.sparkContext.broadcast(content)  # the vocabulary file: of a fixed size

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(shipped.value)
        for batch in batches:
            ids = vocabulary.merge(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    rows = counts.where(F.col("level") >= level).select("word").mapInArrow(merge, "word binary, ids array<int>").toArrow()
    return Lexicon.compiled(dict(zip(rows["word"].to_pylist(), rows["ids"].to_pylist(), strict=True)))


def share_lexicon(spark: SparkSession, blob: bytes) -> str:
    """Put a compiled lexicon into the shared folder and hand it to all executors; its name among Spark's files."""
    path = table_path(spark, "lexicon")
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    try:
        for at in range(0, len(blob), 1 << 20):
            out.write(bytearray(blob[at : at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


@lru_cache(2)
def _mapped(name: str) -> Lexicon:
    from pyspark import SparkFiles

    return Lexicon(np.memmap(SparkFiles.get(name), np.uint8, "r"))


def tokenize(docs: DataFrame, path: str, text: str = "text", decode: bool = False, lexicon: bytes | None = None) -> DataFrame:
    """``docs`` with ``ids`` and, if asked for, with ``decoded``, which is made of the ids alone.

    ``path`` is the driver's path of a byte-level BPE vocabulary in the tokenizers library's format.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        content = f.read()
    name = share_lexicon(spark, build_lexicon(docs, content, text) if lexicon is None else lexicon)
    shipped, pattern = spark.sparkContext.broadcast(content), word_pattern()
    kept = without(docs, *[c for c in ("ids", "decoded") if c != text])
    schema = StructType([f for f in kept.schema.fields if f.name != text or text not in ("ids", "decoded")] + [StructField("ids", ArrayType(IntegerType()))] + ([StructField("decoded", StringType())] if decode else []))
    arrow, at_text = to_arrow_schema(schema), kept.columns.index(text)
    own = [k for k, c in enumerate(kept.columns) if c not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(shipped.value)
        encoder, decoder = Encoder(vocabulary, _mapped(name), pattern), Decoder(vocabulary)
        for batch in batches:
            texts = batch.column(at_text)
            at = 0
            while at < batch.num_rows:  # about a block of text at a time
                end, size = at, 0
                while end < batch.num_rows and (end == at or size < BLOCK_CHARS):
                    size += len(texts[end].as_buffer() or b"")
                    end += 1
                part = batch.slice(at, end - at)
                ids, counts = encoder.encode(texts.slice(at, end - at).to_pylist())
                ends = np.append(0, np.cumsum(counts))
                columns = [part.column(k) for k in own] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
                if decode:
                    columns.append(pa.array([decoder.decode(ids[a:b]) for a, b in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                at = end

    return kept.mapInArrow(run, schema)


def detokenize(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of their ids."""
    with open(path, "rb") as f:
        content = f.read()
    shipped = rows.sparkSession.sparkContext.broadcast(content)
    kept = without(rows, "decoded")
    schema = StructType([*kept.schema.fields, StructField("decoded", StringType())])
    arrow, at_ids = to_arrow_schema(schema), kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary.of(shipped.value))
        for batch in batches:
            lists = [np.array([i for i in x or [] if i is not None], np.int64) for x in batch.column(at_ids).to_pylist()]
            columns = [*batch.columns, pa.array(map(decoder.decode, lists), pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return kept.mapInArrow(run, schema)


def op12_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))

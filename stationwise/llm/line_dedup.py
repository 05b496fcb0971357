"""Line dedup with sharded cuckoo filters over exact reference counts.

The index holds, exactly, which document holds which line key (``refs``), how many documents hold each key that enough
of them hold and the largest of these (``frequent``), and a cuckoo filter of such keys (``filters``); all three by shards of
the key space.  Cuckoo filters can delete, so documents can be added to and taken out of the index again; a key enters its
filter when it reaches the number of documents and leaves when it falls below.  Only the shards that a change touches are
written anew.  A filter that its shard's keys outgrow is built again with twice the room, and an index whose shards hold too
many keys is dealt to twice the shards.  To clean documents, their lines are first held against the filters, which passes
all lines that may have to go and hardly any other; those are then looked up in the exact counts.

The filters travel to the lines while all of them together are small (``PROBE_BYTES``, checked);
beyond that, lines travel to the shard of their key, several copies of each filter sharing the
lines of a hot key.

A key is its line without ASCII white space at both ends, ASCII letters lower-cased, as a 128-bit
hash.  Null and empty texts are one empty line.  Each row is a document; rows that repeat an id
count one by one, and where a null id holds a line, any other id is larger.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stationwise.llm.common import copied_if_small, materialize, table, table_path, without

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS, PROBE_BYTES, PROBE_COPIES = 50_000, 32 << 20, 32
_SLOTS, _KICKS = 4, 200
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Keys are uint64; 16-bit fingerprints in buckets of four; keys that find no slot stay in ``stash``."""

    def __init__(self, capacity: int):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / _SLOTS / 0.85))))
        self.table, self.stash = np.zeros((buckets, _SLOTS), np.uint16), []

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        out, n = cls(1), int.from_bytes(blob[:8], "little")
        out.table = np.frombuffer(blob, np.uint16, n * _SLOTS, 8).reshape(n, _SLOTS).copy()
        out.stash = np.frombuffer(blob, np.uint64, offset=8 + n * _SLOTS * 2).tolist()
        return out

    def dump(self) -> bytes:
        return len(self.table).to_bytes(8, "little") + self.table.tobytes() + np.array(self.stash, np.uint64).tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = ((keys >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = keys & mask
        return mark, first.astype(np.int64), (first ^ self._step(mark)).astype(np.int64)

    def _step(self, mark) -> np.ndarray:
        return (np.asarray(mark).astype(np.uint64) * _MIX >> np.uint64(20)) & np.uint64(len(self.table) - 1)

    def insert(self, keys: np.ndarray) -> None:
        rng = np.random.default_rng(len(self.table))
        for key, mark, one, two in zip(keys, *self._places(keys), strict=True):
            at, moves = next((b for b in (one, two) if (self.table[b] == 0).any()), None), []
            if at is None:
                at = one
                for _ in range(_KICKS):
                    k = int(rng.integers(_SLOTS))
                    moves.append((at, k, self.table[at, k]))
                    self.table[at, k], mark = mark, self.table[at, k]
                    at = int(at) ^ int(self._step(mark))
                    if (self.table[at] == 0).any():
                        break
                else:  # undo; the key itself stays whole
                    for b, k, old in reversed(moves):
                        self.table[b, k] = old
                    self.stash.append(int(key))
                    continue
            self.table[at, int(np.flatnonzero(self.table[at] == 0)[0])] = mark

    def delete(self, keys: np.ndarray) -> None:
        for key, mark, one, two in zip(keys, *self._places(keys), strict=True):
            if int(key) in self.stash:
                self.stash.remove(int(key))
                continue
            for b in (one, two):
                if (at := np.flatnonzero(self.table[b] == mark)).size:
                    self.table[b, at[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        mark, one, two = self._places(keys)
        found = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        return found | np.isin(keys, np.array(self.stash, np.uint64)) if self.stash else found


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(k_id, k_text, pos, h1, h2, first)``: the lines with long enough keys; ``first`` within their document."""
    rows = docs.select(F.col(doc_id).alias("k_id"), F.xxhash64(text, F.length(text)).alias("k_text"), F.col(text).alias("text"))
    kind = rows.schema["k_id"].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            at, pos, digests, first = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                seen: set[bytes] = set()
                for k, line in enumerate((text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")):
                    line = line.strip()
                    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "surrogatepass")) < min_chars:
                        continue
                    digest = xxhash.xxh3_128_digest(line)
                    at.append(i)
                    pos.append(k)
                    digests.append(digest)
                    first.append(digest not in seen)
                    seen.add(digest)
            if at:
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(first)],
                    ["k_id", "k_text", "pos", "h1", "h2", "first"],
                )

    return rows.mapInArrow(lines, f"k_id {kind}, k_text long, pos int, h1 long, h2 long, first boolean")


def _build(rows: DataFrame) -> DataFrame:
    """``(shard, capacity, blob)`` from ``(shard, step, h1, blob, capacity)``: a filter to start from (0), keys to take out (1) and to put in (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made, room = None, None, 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([room], pa.int64()), pa.array([made.dump()], pa.binary())], ["shard", "capacity", "blob"])

        for batch in batches:
            shards, steps, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(steps) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True):
                if b == a:
                    continue
                if shards[a] != held:
                    if held is not None:
                        yield out()
                    held, room = int(shards[a]), batch.column(4)[int(a)].as_py()
                    made = CuckooFilter(room)
                if steps[a] == 0:
                    made = CuckooFilter.load(batch.column(3)[int(a)].as_py())
                else:
                    (made.delete if steps[a] == 1 else made.insert)(keys[a:b].view(np.uint64))
        if held is not None:
            yield out()

    return rows.repartition("shard").sortWithinPartitions("shard", "step").select("shard", "step", "h1", "blob", "capacity").mapInArrow(run, "shard long, capacity long, blob binary")


@dataclass(frozen=True)
class Stored:
    """A table of the shared folder in a folder per shard."""

    spark: SparkSession
    schema: StructType
    folders: dict[int, str]

    @classmethod
    def of(cls, df: DataFrame, name: str) -> Stored:
        return cls(df.sparkSession, df.schema, {}).replaced(df, name)

    def read(self, shards: set[int] | None = None) -> DataFrame:
        chosen = [f for s, f in self.folders.items() if shards is None or s in shards]
        return self.spark.read.schema(self.schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], self.schema)

    def replaced(self, df: DataFrame, name: str, shards: set[int] = frozenset()) -> Stored:
        """With the rows of ``df``, which has all that ``shards`` hold from now on."""
        path = table_path(self.spark, name)
        df.withColumn("part", F.col("shard")).repartition("shard").write.partitionBy("part").parquet(path)
        schema = StructType([*self.schema.fields, StructField("part", LongType())])
        found = self.spark.read.schema(schema).parquet(path).select("part").distinct().collect()  # at most one a shard
        new = {r.part: f"{path}/part={r.part}" for r in found}
        return Stored(self.spark, self.schema, {s: f for s, f in self.folders.items() if s not in shards} | new)


@dataclass(frozen=True)
class LineIndex:
    """``refs(shard, h1, h2, k_id, k_text)``, a row per document and key; ``frequent`` keys; their filters.

    ``refs`` are a plan until the index changes for the first time, so that documents which are cleaned once leave no table.
    """

    refs: DataFrame | Stored
    frequent_keys: Stored
    filters: Stored
    shards: int
    min_docs: int = MIN_DOCS
    shard_keys: int = SHARD_KEYS

    @classmethod
    def of(cls, lines: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        """The index of ``lines``, as ``line_keys`` gives them."""
        refs = lines.where("first").select("h1", "h2", "k_id", "k_text")
        frequent = materialize(cls._counts(refs, min_docs), "line-counts")
        shards = max(1, -(-frequent.count() // shard_keys))
        sharded = lambda df: df.select(F.pmod("h2", F.lit(shards)).alias("shard"), *df.columns)
        keys = sharded(frequent)
        sizes = keys.groupBy("shard").agg(F.count(F.lit(1)).alias("capacity"))
        rows = keys.join(copied_if_small(materialize(sizes, "line-sizes"), 16), "shard").select("shard", F.lit(2).alias("step"), "h1", F.lit(None).cast("binary").alias("blob"), "capacity")
        return cls(sharded(refs), Stored.of(keys, "line-frequent"), Stored.of(_build(rows), "line-filters"), shards, min_docs, shard_keys)

    @staticmethod
    def _counts(refs: DataFrame, min_docs: int, *by: str) -> DataFrame:
        return refs.groupBy(*by, "h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("k_id").alias("last")).where(F.col("n_docs") >= min_docs)

    def all_refs(self) -> DataFrame:
        return self.refs.read() if isinstance(self.refs, Stored) else self.refs

    def frequent(self) -> DataFrame:
        return self.frequent_keys.read().select("h1", "h2", "n_docs", "last")

    def _kept(self) -> Stored:
        return self.refs if isinstance(self.refs, Stored) else Stored.of(self.refs, "line-refs")

    def insert(self, lines: DataFrame) -> LineIndex:
        new = materialize(lines.where("first").select(F.pmod("h2", F.lit(self.shards)).alias("shard"), "h1", "h2", "k_id", "k_text"), "lines-new")
        refs = self._kept()
        touched = {r.shard for r in new.select("shard").distinct().collect()}
        return self._moved(refs.replaced(refs.read(touched).unionByName(new), "line-refs", touched), touched)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents whose ids ``doc_ids(k_id)`` lists."""
        gone = doc_ids.select(F.col("k_id").alias("_g")).distinct()
        refs, same = self._kept(), F.col("k_id").eqNullSafe(F.col("_g"))
        touched = {r.shard for r in refs.read().join(gone, same, "left_semi").select("shard").distinct().collect()}
        return self._moved(refs.replaced(refs.read(touched).join(gone, same, "left_anti"), "line-refs", touched), touched)

    def _moved(self, refs: Stored, touched: set[int]) -> LineIndex:
        """Keys of the touched shards that became frequent enter their filter, keys that no longer are leave it."""
        then = self.frequent_keys.read(touched).select("shard", "h1", "h2")
        frequent = self.frequent_keys.replaced(self._counts(refs.read(touched), self.min_docs, "shard"), "line-frequent", touched)
        now = frequent.read(touched).select("shard", "h1", "h2")
        # a number or two for each touched shard
        size = {r.shard: r.n for r in now.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = {r.shard: r.capacity for r in self.filters.read(touched).select("shard", "capacity").collect()}
        if max(size.values(), default=0) > 4 * self.shard_keys:
            return self._wider(refs)
        anew = {s for s in touched if size.get(s, 0) > room.get(s, 0) or 8 * size.get(s, 0) < room.get(s, 0)}
        fit = {s: 2 * size.get(s, 0) if s in anew else room.get(s, 0) for s in touched}
        none, among = F.lit(None).cast("binary").alias("blob"), lambda df, shards: df.where(F.col("shard").isin(sorted(shards)))
        keys = lambda df, step: df.select("shard", F.lit(step).alias("step"), "h1", none)
        start = among(self.filters.read(touched), touched - anew).select("shard", F.lit(0).alias("step"), F.lit(0).cast("long").alias("h1"), "blob")
        gone, new = (x.join(y, ["shard", "h1", "h2"], "left_anti") for x, y in ((then, now), (now, then)))
        rows = start.unionByName(keys(among(gone, touched - anew), 1)).unionByName(keys(among(new, touched - anew), 2)).unionByName(keys(among(now, anew), 2))
        rooms = self.filters.spark.createDataFrame(sorted(fit.items()), "shard long, capacity long")
        rows = rows.join(F.broadcast(rooms), "shard")
        return replace(self, refs=refs, frequent_keys=frequent, filters=self.filters.replaced(_build(rows), "line-filters", touched))

    def _wider(self, refs: Stored) -> LineIndex:
        """Dealt to as many shards as its keys ask for now, at least twice as many."""
        lines = refs.read().withColumn("first", F.lit(True))
        n = self._counts(lines, self.min_docs).count()
        return LineIndex.of(lines, self.min_docs, max(1, min(self.shard_keys, n // (2 * self.shards))))._with(self.shard_keys)

    def _with(self, shard_keys: int) -> LineIndex:
        return replace(self, refs=self._kept(), shard_keys=shard_keys)

    def candidates(self, lines: DataFrame, probe_bytes: int = PROBE_BYTES) -> DataFrame:
        """The lines whose key the filters may hold."""
        size = self.filters.read().agg(F.sum(F.octet_length("blob"))).first()[0] or 0
        return self._probe_here(lines) if size <= probe_bytes else self._probe_there(lines)

    def _probe_here(self, lines: DataFrame) -> DataFrame:
        shards = self.shards
        blobs = lines.sparkSession.sparkContext.broadcast({r.shard: bytes(r.blob) for r in self.filters.read().collect()})  # at most PROBE_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: CuckooFilter.load(b) for s, b in blobs.value.items()}
            for batch in batches:
                h1, h2 = batch.column("h1").to_numpy().view(np.uint64), batch.column("h2").to_numpy()
                of, hit = h2 % shards, np.zeros(len(h1), bool)
                for s in np.unique(of):
                    if s in filters:
                        hit[of == s] = filters[s].contains(h1[of == s])
                yield batch.filter(pa.array(hit))

        return lines.mapInArrow(run, lines.schema)

    def _probe_there(self, lines: DataFrame, copies: int = PROBE_COPIES) -> DataFrame:
        names = lines.columns
        salt = F.pmod(F.xxhash64("k_id", "k_text"), F.lit(copies)).cast("int")
        rows = lines.withColumns({"shard": F.pmod("h2", F.lit(self.shards)), "salt": salt, "blob": F.lit(None).cast("binary")})
        filters = self.filters.read().drop("capacity").withColumn("h1", F.lit(0).cast("long")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        both = rows.unionByName(filters, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, filt = None, None
            for batch in batches:
                shard, salt, blob = (batch.column(c) for c in ("shard", "salt", "blob"))
                group = shard.to_numpy().astype(np.int64) * copies + salt.to_numpy()
                keys, hit = batch.column("h1").to_numpy(), np.zeros(len(group), bool)
                loads = np.flatnonzero(blob.is_valid().to_numpy(zero_copy_only=False))
                starts = sorted({0, *(np.flatnonzero(np.diff(group)) + 1), *loads, *(loads + 1)} - {len(group)})
                for a, b in zip(starts, [*starts[1:], len(group)], strict=True):
                    if blob[int(a)].is_valid:
                        held, filt = group[a], CuckooFilter.load(blob[int(a)].as_py())
                    elif group[a] == held:
                        hit[a:b] = filt.contains(keys[a:b].view(np.uint64))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names], names).filter(pa.array(hit))

        return both.mapInArrow(run, lines.schema)

    def drops(self, lines: DataFrame, probe_bytes: int = PROBE_BYTES) -> DataFrame:
        """``(k_id, k_text, drops)``: positions of the lines that go, held by another document than the last."""
        found = self.candidates(lines, probe_bytes).join(self.frequent(), ["h1", "h2"])
        gone = found.where(~F.col("k_id").eqNullSafe(F.col("last")))
        return gone.groupBy("k_id", "k_text").agg(F.collect_set("pos").alias("drops"))


def drop_lines(docs: DataFrame, drops: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    drops = drops.withColumnsRenamed({"k_id": "_g", "k_text": "_h", "drops": "_d"})
    gone = F.coalesce("_d", F.array().cast("array<int>"))
    keyed = docs.withColumn("_t", F.xxhash64(text, F.length(text)))
    joined = keyed.join(drops, F.col(doc_id).eqNullSafe(F.col("_g")) & F.col("_t").eqNullSafe(F.col("_h")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), gone)
    joined = joined.withColumn("_l", lines)
    kept = F.array_join(F.transform(stay, lambda i: F.get("_l", i)), "\n")
    return without(joined.select(*docs.columns, "_l", "_d"), "n_lines", "n_dropped", "kept_text").select("*", F.size("_l").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), kept.alias("kept_text")).drop("_l", "_d")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, probe_bytes: int = PROBE_BYTES) -> DataFrame:
    lines = materialize(line_keys(docs, doc_id, text, min_chars), "lines")
    return drop_lines(docs, LineIndex.of(lines, min_docs).drops(lines, probe_bytes), doc_id, text)


def op2_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), freq AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT keyed.doc_id, pos, line, freq.k IS NOT NULL AND keyed.doc_id <> last AS gone
  FROM keyed LEFT JOIN freq ON keyed.k = freq.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

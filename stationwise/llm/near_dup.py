"""Near-duplicates by MinHash signatures and a multi-index Hamming join, confirmed on full sets.

1. Documents with equal shingle sets form a class; classes stand for their documents from here on.
2. A class's signature has ``HASHES`` symbols.  Two sets with a similarity of 0.85 differ in 15 % of
   them on average, and in more than ``DISTANCE`` (19 of 40) twice in ten million.  Other similarities have
   the distance with the same chance of a miss (``distance_of``: 22 at 0.80); those too low for it are refused.
   Signatures are cut into chunks, 10 at 0.85 and 12 at 0.80, so that by the pigeonhole principle two
   signatures within the distance have a chunk with one error at most.  For each chunk, keys are enumerated
   with each choice of one symbol masked, so all pairs within the distance share a key: none is missed.
3. Keys of one class only go at once; what travels for that is a key and a number.  For the others, a task compares the
   signatures of a key's classes in blocks and gives a forest that joins those within the distance, never the pairs.
   A key of more than ``KEY_BLOCK`` classes is cut into blocks, and each pair of blocks is a task.
4. What these forests join are clusters.  First every class of a cluster is held against the cluster's least class, its
   pivot, by the intersection of the full sets.  Classes that are not linked with it are then held against each other
   and all others of the cluster, block by block, so that a cluster costs its size times one more than the number of
   blocks of such classes.
5. The forests' components are the near-duplicate groups.

Null, empty and blank texts have empty sets and are linked with nothing.  Texts with fewer words than a
shingle are one shingle.  Repeated rows share a class.  A null id counts as the largest of its group.  An
empty table gives an empty result; columns that clash with the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import copied_if_small, materialize, table
from stationwise.llm.components import components
from stationwise.llm.hashing import WordHashes, mix, runs

SHINGLE, PERCENT = 5, 85
HASHES, DISTANCE, CHUNKS = 40, 19, 10
MISSED = 3e-7  # the largest chance that a pair at the least similarity lies beyond the distance
BLOCK, KEY_BLOCK = 512, 1_024
_M1 = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(5_497)
_ODD = _RNG.integers(0, 1 << 63, (HASHES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, (HASHES, 1), np.uint64) * np.uint64(2)


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text's word hashes."""
    return np.unique(runs(words, min(size, len(words)))) if len(words) else words


def shingle_sets(texts: list[str | None], hashes: WordHashes, size: int = SHINGLE) -> list[np.ndarray]:
    return [shingle_set(hashes.of((t or "").encode("utf-8", "surrogatepass").lower().split()), size) for t in texts]


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4_096):
        least = np.minimum(least, ((shingles[None, a : a + 4_096] ^ _XOR) * _ODD).min(1))
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def _signed(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``(doc_id, k_text, n_shingles, class, sig)``; class and signature are null for empty sets."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text, F.length(text)).alias("k_text"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            n, cls, sig = [], [], []
            for s in shingle_sets(batch.column(2).to_pylist(), hashes, size):
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "k_text", "n_shingles", "class", "sig"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, k_text long, n_shingles long, class binary, sig binary")


def distance_of(percent: float) -> tuple[int, int]:
    """The distance that serves a similarity of ``percent`` or more, and into how many chunks signatures are cut for it."""
    if not 0 < percent <= 100:
        raise ValueError(f"no similarity: {percent} %")
    off = 1 - percent / 100
    beyond, distance = 0.0, HASHES
    while distance and (more := beyond + comb(HASHES, distance) * off**distance * (1 - off) ** (HASHES - distance)) <= MISSED:
        beyond, distance = more, distance - 1
    chunks = distance // 2 + 1
    if 3 * chunks > HASHES:
        raise ValueError(f"{HASHES} symbols cannot serve a similarity of {percent} %: keys would have one symbol")
    return distance, chunks


def masks(hashes: int = HASHES, distance: int = DISTANCE, chunks: int = CHUNKS) -> list[np.ndarray]:
    """The symbols that each key is made of: every chunk, with each choice of its allowed errors left out."""
    errors = distance // chunks
    out = []
    for chunk in np.array_split(np.arange(hashes), chunks):
        out += [np.array([i for i in chunk if i not in left], int) for left in combinations(chunk, min(errors, len(chunk) - 1))]
    return out


def _keyed(classes: DataFrame, distance: int, chunks: int) -> DataFrame:
    """``(key, c8)``, a row per key of a class, which is known by eight bytes here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = masks(distance=distance, chunks=chunks)
        for whole in batches:
            for a in range(0, whole.num_rows, 2_000):
                batch = whole.slice(a, 2_000)
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, HASHES)
                keys = np.empty((len(sig), len(chosen)), np.uint64)
                for k, mask in enumerate(chosen):
                    h = np.full(len(sig), k + 1, np.uint64) * _M1
                    for i in mask:
                        h = mix(h + sig[:, i].astype(np.uint64) * _M1)
                    keys[:, k] = h
                take = pa.array(np.repeat(np.arange(len(sig)), len(chosen)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column(0).take(take)], ["key", "c8"])

    return classes.select("c8", "sig").mapInArrow(run, "key long, c8 long")


def _shared(keyed: DataFrame, block: int) -> DataFrame:
    """``(key, c8, block, blocks)``: the rows of keys that several classes have, dealt to blocks of ``block`` classes.

    For each key of several blocks there is one row more, without a class, that has their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, held = None, 0, 0  # the run so far, and its first class while it is the only one

        def pack(keys, c8, blocks, marks) -> pa.RecordBatch:
            n = len(keys)
            columns = [np.append(keys, [k for k, _ in marks]).astype(np.int64), np.append(c8, np.zeros(len(marks))).astype(np.int64) if not n else np.concatenate([c8, np.zeros(len(marks), np.int64)])]
            mark = np.arange(n + len(marks)) >= n
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1], mask=mark), pa.array(np.concatenate([blocks, np.zeros(len(marks), np.int64)]), mask=mark), pa.array(np.concatenate([np.zeros(n, np.int64), np.array([-(-c // block) for _, c in marks], np.int64)]), mask=~mark)],
                ["key", "c8", "block", "blocks"],
            )

        for batch in batches:
            keys, c8 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            bounds = np.append(np.append(0, np.flatnonzero(np.diff(keys)) + 1), len(keys))
            lengths, marks = np.diff(bounds), []
            place, total = np.arange(len(keys)) - np.repeat(bounds[:-1], lengths), lengths.copy()
            if goes_on := keys[0] == last:
                place[: lengths[0]] += count
                total[0] += count
            elif count > block:
                marks.append((last, count))
            marks += [(keys[bounds[k]], total[k]) for k in np.flatnonzero(total[:-1] > block)]
            give = np.repeat(total > 1, lengths)
            out = keys[give], c8[give], place[give] // block
            if goes_on and count == 1:
                out = np.append(last, out[0]), np.append(held, out[1]), np.append(0, out[2])
            if len(out[0]) or marks:
                yield pack(*out, marks)
            last, count, held = keys[-1], int(total[-1]), c8[-1]
        if count > block:
            yield pack(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [(last, count)])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, c8 long, block long, blocks long")


def _met(classes: DataFrame, distance: int, chunks: int, block: int) -> DataFrame:
    """``(key, class, sig)``: classes that share a key; those of frequent keys once for each pair of blocks that they are in."""
    shared = materialize(_shared(_keyed(classes, distance, chunks), block), "keys-shared")
    several = shared.where("blocks IS NOT NULL").select(F.col("key").alias("s_key"), F.col("blocks").alias("n"))
    members = shared.where("c8 IS NOT NULL").select("key", "c8", "block")
    members = members.join(copied_if_small(several, 16), F.col("key") == F.col("s_key"), "left").withColumn("n", F.coalesce("n", F.lit(1)))
    known = members.join(classes.select(F.col("c8").alias("m8"), "class", "sig"), F.col("c8") == F.col("m8"))
    other = known.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return other.select(F.when(F.col("n") == 1, F.col("key")).otherwise(pair).alias("key"), "class", "sig")


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j

    def labels(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])


def within_distance(sig: np.ndarray, distance: int = DISTANCE, block: int = 256) -> list[tuple[int, int]]:
    """Edges of a forest with the components of the graph of signatures within ``distance``."""
    forest, edges = Forest(len(sig)), []
    for a in range(len(sig)):
        label = forest.labels() if a % block == 0 else label
        rest = np.flatnonzero(label[a + 1 :] != label[a]) + a + 1
        for lo in range(0, len(rest), 65_536):
            at = rest[lo : lo + 65_536]
            for b in at[(sig[at] != sig[a]).sum(1) <= distance]:
                if forest.join(a, int(b)):
                    edges.append((a, int(b)))
        if len(edges) == len(sig) - 1:
            break
    return edges


def _candidates(keyed: DataFrame, distance: int) -> DataFrame:
    """``(a, b)``: for each key, a forest of the classes whose signatures are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(pairs):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        pairs: list[tuple[bytes, bytes]] = []

        def bucket(rows: pa.Table) -> None:
            cls = rows.column(1).to_pylist()
            sig = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint16).reshape(-1, HASHES)
            if len(cls) == 2:
                if (sig[0] != sig[1]).sum() <= distance:
                    pairs.append((cls[0], cls[1]))
            else:
                pairs.extend((cls[a], cls[b]) for a, b in within_distance(sig, distance))

        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(keys))
            if held and len(keys) and held[-1].column(0)[0].as_py() != keys[0]:
                bucket(pa.Table.from_batches(held))
                held = []
            for a, b in zip(starts, ends, strict=True):
                if b == len(keys) or (held and a == 0):
                    held.append(batch.slice(a, b - a))
                    if b < len(keys):
                        bucket(pa.Table.from_batches(held))
                        held = []
                elif b - a > 1:
                    bucket(batch.slice(a, b - a))
            if len(pairs) > 50_000:
                yield pack(pairs)
                pairs.clear()
        if held:
            bucket(pa.Table.from_batches(held))
        if pairs:
            yield pack(pairs)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a binary, b binary")


def confirmed(left: list[np.ndarray], right: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges of a forest of the links between two lists of sets (or within one: ``right`` is ``left``)."""
    own = right is left
    sets = left if own else left + right
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    term = np.empty(len(flat), np.int64)
    term[order] = np.cumsum(np.append(0, np.diff(flat[order]) != 0))
    often = np.bincount(term)[term] > 1
    doc, term = doc[often], term[often]
    n, m = len(left), len(right)
    both = np.zeros((n, m), np.float32)
    if len(term):
        ids, term = np.unique(term, return_inverse=True)
        order = np.argsort(term, kind="stable")
        doc, term = doc[order], term[order]
        for a in range(0, len(ids), 4_096):
            lo, hi = np.searchsorted(term, (a, a + 4_096))
            grid = np.zeros((len(sets), min(4_096, len(ids) - a)), np.float32)
            grid[doc[lo:hi], term[lo:hi] - a] = 1
            both += grid[:n] @ (grid if own else grid[n:]).T
    common = both.astype(np.int64)
    a, b = np.nonzero(100 * common >= percent * (size[:n, None] + (size if own else size[n:])[None, :] - common))
    forest, edges = Forest(len(sets)), []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if (not own or i < j) and forest.join(i, j if own else n + j):
            edges.append((i, j))
    return edges


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` from ``(cluster, i, j, side, class, set)``: forests of the confirmed links of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = None, ([], [])

        def out():
            names = [[c for c, _ in g] for g in group]
            arrays = [[s for _, s in g] for g in group]
            own = held[1] == held[2]
            edges = confirmed(arrays[0], arrays[0] if own else arrays[1], percent) if arrays[0] and (own or arrays[1]) else []
            return [(names[0][a], names[0 if own else 1][b]) for a, b in edges]

        def pack(pairs):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)], ["a", "b"])

        pairs = []
        for batch in batches:
            cluster, i, j, side, cls, sets = (c.to_pylist() for c in batch.columns)
            for k in range(batch.num_rows):
                if (cluster[k], i[k], j[k]) != held:
                    if held is not None:
                        pairs += out()
                    held, group = (cluster[k], i[k], j[k]), ([], [])
                group[side[k]].append((cls[k], np.frombuffer(sets[k], np.uint64)))
            if len(pairs) > 20_000:
                yield pack(pairs)
                pairs = []
        if held is not None:
            pairs += out()
        if pairs:
            yield pack(pairs)

    order = ["cluster", "i", "j"]
    return sets.repartition(*order).sortWithinPartitions(*order, "side").select(*order, "side", "class", "set").mapInArrow(run, "a binary, b binary")


def _full_sets(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``set`` in place of ``text``, without those that share a class's id but not its set."""
    names = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", set binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                sets = [s.tobytes() for s in shingle_sets(part.column("text").to_pylist(), hashes, size)]
                own = pa.array([xxhash.xxh3_128_digest(s) == c for s, c in zip(sets, part.column("class").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "set"]).filter(own)

    return rows.mapInArrow(run, schema)


def _confirmed_links(docs: DataFrame, clusters: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """``(a, b)``: forests of the confirmed links between the classes of each of ``clusters(class, cluster, first_id)``."""
    dealt = lambda n: F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n)
    place = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = clusters.join(clusters.groupBy("cluster").agg(dealt("n")), "cluster").withColumn("block", place("n"))
    placed = materialize(placed, "placed")
    # one row of documents per class: its first id, and among rows with that id those with the class's set
    rows = docs.join(copied_if_small(placed, 100), F.col("d_id").eqNullSafe(F.col("first_id")))
    sets = materialize(_full_sets(rows.select("class", "cluster", "n", "block", "text"), size), "sets")
    # the pivot meets each block of its cluster
    star = sets.select("cluster", F.col("block").alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), "class", "set")
    pivots = sets.where(F.col("class") == F.col("cluster")).select("cluster", to("n").alias("i"), F.lit(-1).alias("j"), F.lit(1).alias("side"), "class", "set")
    first = materialize(_links(star.unionByName(pivots), percent), "links-pivot")
    # every edge has its cluster's pivot on one side: the other is linked
    linked = first.select(F.col("a").alias("l")).unionByName(first.select(F.col("b").alias("l"))).distinct()
    marked = placed.join(linked, F.col("class") == F.col("l"), "left").withColumn("linked", F.col("l").isNotNull()).drop("l")
    pivot = F.col("class") == F.col("cluster")
    open_ = marked.where(~pivot).groupBy("cluster").agg(F.count_if(~F.col("linked")).alias("rest"), F.count_if("linked").alias("others"))
    open_ = open_.where("rest > 1 OR rest = 1 AND others > 0").select(F.col("cluster").alias("o"), F.ceil(F.col("rest") / block).cast("int").alias("rests"))
    marked = marked.where(~pivot).join(open_, F.col("cluster") == F.col("o")).select(F.col("class").alias("m"), "linked", "rests")
    marked = materialize(marked, "classes-open")
    left = sets.join(copied_if_small(marked, 32), F.col("class") == F.col("m"))
    rest = left.where("NOT linked").withColumn("own", place("rests"))
    pairs = rest.withColumn("other", to("rests")).select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "class", "set"
    )
    far = rest.withColumn("b", to("n")).select("cluster", F.col("own").alias("i"), (F.col("rests") + F.col("b")).alias("j"), F.lit(0).alias("side"), "class", "set")
    near = left.where("linked").withColumn("i", to("rests")).select("cluster", "i", (F.col("rests") + F.col("block")).alias("j"), F.lit(1).alias("side"), "class", "set")
    return first.unionByName(_links(pairs.unionByName(far).unionByName(near), percent))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, key_block: int = KEY_BLOCK) -> DataFrame:
    """``(doc_id, k_text, n_shingles, class, component_id, kept)``, one row per row of ``docs``; ``k_text`` is a hash of its text."""
    distance, chunks = distance_of(percent)
    signed = materialize(_signed(docs, doc_id, text, size), "signed")
    classes = signed.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("c8", F.xxhash64("class")), "classes")
    clusters = components(_candidates(_met(classes, distance, chunks, key_block), distance)).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    clusters = materialize(clusters.join(classes.select("class", "first_id"), "class"), "clusters")
    rows = docs.select(F.col(doc_id).alias("d_id"), F.col(text).alias("text"))
    links = components(_confirmed_links(rows, clusters, size, percent, block))
    found = links.select(F.col("node").alias("class"), "root").join(classes.select("class", "first_id"), "class")
    least = found.groupBy("root").agg(F.min("first_id").alias("least_id"))
    grouped = found.join(least, "root").select("class", "least_id")
    known = classes.select("class", "first_id").join(grouped, "class", "left").select(F.col("class").alias("c"), F.coalesce("least_id", "first_id").alias("component_id"))
    out = signed.drop("sig").join(known, F.col("class") == F.col("c"), "left").drop("c")
    out = out.withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group; rows that repeat its id and text are that document."""
    gone = near_duplicates(docs, doc_id, text, **how).where("not kept").select(F.col("doc_id").alias("_g"), F.col("k_text").alias("_h")).distinct()
    gone = copied_if_small(materialize(gone, "near-copies"), 16)
    own = docs.withColumn("_t", F.xxhash64(text, F.length(text)))
    return own.join(gone, F.col(doc_id).eqNullSafe(F.col("_g")) & F.col("_t").eqNullSafe(F.col("_h")), "left_anti").drop("_t")


def op9_multi_index_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")

"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents should have:
a whole part, which it gets, and a fraction, which is rounded.  Two documents at a time pass mass
between them, at random but so that the expected copies of each stay and the words of both
together do not change, until one has a whole number; the other meets the next.  A document more
than twice as long as the next meets all that are left in its bucket at once, as one partner, each of
which gives or takes in proportion to its length.  The one left over in a bucket goes up a tree, to
be rounded with those of other buckets, so no task reads a whole source.  Every eighth document goes
up with it unrounded, so that long documents meet enough short ones at each level.  The one left at
the top of a source goes to the nearer whole number: a source misses its target by half of that
document, and that one document's copies, alone in its source, are not true to their fraction on average.

Null texts have size 0; documents of size 0 are rounded on their own and take no words.  A null
source is a source.  Repeated rows are separate documents.  Random numbers come from a seed and the
document's place, so reruns agree.  An empty table gives an empty result; columns that clash with
the result's names are replaced.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stationwise.llm.common import WORD, copied_if_small, materialize, table

WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
BUCKET, FANOUT, HOLD, SEED = 64, 8, 8, 20_240_601


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Targets of ``sizes(source, source_size, n_docs)``, one row per source.

    Weights repeat over the sources in order of code point, null last.  Where a target would be above
    ``most`` times its source's size it stops there and the rest is shared anew by weight.  That
    ends at a level per unit of weight; sources with the least size per unit stop first.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", w).withColumn("_cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    free = F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = ranked.withColumn("_level", left / free)
    level = level.withColumn("_level", F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(all_)["_level"])
    target = F.coalesce(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")), F.col("_cap").cast("double"))
    return level.select("source", "source_size", "n_docs", target.alias("target"))


def pivot(docs: list[tuple[float, int]], rng: random.Random) -> tuple[list[int], int | None, float]:
    """Round the fractions of ``docs(fraction, size)``, sizes above 0 and falling.

    Gives each document's 0 or 1, and the place and fraction of the one left over, if any.
    """
    p, size, out = [q for q, _ in docs], [s for _, s in docs], [0] * len(docs)
    open_ = list(range(len(docs)))
    while len(open_) > 1:
        i, rest = open_[0], open_[1:]
        near = rest[:1] if 2 * size[rest[0]] >= size[i] else rest
        words = sum(size[j] for j in near)
        up = min((1 - p[i]) * size[i], words * min(p[j] for j in near))
        down = min(p[i] * size[i], words * (1 - max(p[j] for j in near)))
        move = up if rng.random() * (up + down) < down else -down
        p[i] += move / size[i]
        for j in near:
            p[j] -= move / words
        for k in [k for k in (i, *near) if not 1e-9 < p[k] < 1 - 1e-9]:
            out[k] = int(p[k] > 0.5)
            open_.remove(k)
    return (out, open_[0], p[open_[0]]) if open_ else (out, None, 0.0)


def _level(rows: DataFrame, level: int, seed: int, top: bool) -> DataFrame:
    """One level of the tree: each (source, bucket) is rounded; ``bit`` stays null for those that go up."""
    names, schema = rows.columns, rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {c: i for i, c in enumerate(names)}

        def each():
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        def packed(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        types, done = [f.type for f in to_arrow_schema(schema)], []
        for place, group in groupby(each(), key=lambda r: (r[at["s_hash"]], r[at["bucket"]])):
            members = [list(r) for r in group]
            now = members if top else [m for i, m in enumerate(members) if i % HOLD != HOLD - 1]
            bits, held, p = pivot([(m[at["p"]], m[at["size"]]) for m in now], random.Random(f"{seed}/{level}/{place}"))
            for m, bit in zip(now, bits, strict=True):
                m[at["bit"]] = bit
            if held is not None:
                now[held][at["p"]], now[held][at["bit"]] = p, int(p >= 0.5) if top else None
            done += members
            if len(done) >= 10_000:
                yield packed(done)
                done = []
        if done:
            yield packed(done)

    dealt = rows.repartition("s_hash", "bucket").sortWithinPartitions("s_hash", "bucket", F.desc("size"), "key", "k_text")
    return dealt.mapInArrow(run, schema)


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``(key, k_text, size, source_size, target, copies)``, one row per row of ``docs``.

    ``k_text`` is a hash of the text, which with the key finds the row again.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text, F.length(text)).alias("k_text"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = materialize(source_targets(sizes, weights, share, most).withColumnRenamed("source", "t_source"), "mix-targets")
    n = math.ceil((targets.agg(F.max("n_docs")).first()[0] or 0) / BUCKET)
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(rate + 1e-12)).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    open_ = (F.col("p") > 1e-9) & (F.col("size") > 0)
    alone = (F.col("size") == 0) & (F.pmod(F.xxhash64(F.lit(seed), "key", "k_text"), F.lit(1 << 30)) / float(1 << 30) < F.col("p"))
    result = ["key", "k_text", "size", "source_size", "target"]
    done = rows.where(~open_).select(*result, (F.col("whole") + alone.cast("long")).alias("copies"))
    bucket = F.pmod(F.xxhash64("key", "k_text"), F.ceil(F.col("n_docs") / BUCKET))
    tree = rows.where(open_).select(*result, F.xxhash64(F.coalesce("source", F.lit("\n"))).alias("s_hash"), "p", bucket.alias("bucket"), F.col("whole").cast("long").alias("whole"), F.lit(None).cast("int").alias("bit"))
    level = 0
    while True:
        tree = materialize(_level(tree, level, seed, top=n <= 1), "mix-level")
        done = done.unionByName(tree.where(F.col("bit").isNotNull()).select(*result, (F.col("whole") + F.col("bit")).alias("copies")))
        if n <= 1:
            return done
        tree = tree.where(F.col("bit").isNull()).withColumn("bucket", F.floor(F.col("bucket") / FANOUT))
        level, n = level + 1, math.ceil(n / FANOUT)


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The mix itself: rows of ``docs`` as they are, each as often as it is taken."""
    copies = mix_sources(docs, key, text, **how).groupBy(F.col("key").alias("_mk"), F.col("k_text").alias("_mt")).agg(F.array_sort(F.collect_list("copies")).alias("_mc"))
    copies = materialize(copies, "mix-copies")
    keyed = docs.withColumn("_t", F.xxhash64(text, F.length(text)))
    same = F.col(key).eqNullSafe(F.col("_mk")) & F.col("_t").eqNullSafe(F.col("_mt"))

    def taken(rows: DataFrame, times: Column) -> DataFrame:
        times = times.cast("int")
        return rows.where(times > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), times)).alias("_copy")).drop("_copy")

    once = copies.where(F.size("_mc") == 1)
    out = taken(keyed.join(copied_if_small(once, 40), same), F.get("_mc", F.lit(0)))
    again = copies.where(F.size("_mc") > 1)
    if again.isEmpty():
        return out
    # rows that repeat id and text: the first takes the first number of copies, and so on
    order = Window.partitionBy(key, "_t").orderBy("_t")
    repeated = keyed.join(again, same).withColumn("_n", F.row_number().over(order) - 1)
    return out.unionByName(taken(repeated, F.get("_mc", F.col("_n"))))


def op1_pivotal_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")

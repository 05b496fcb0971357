"""Sharding by jump consistent hashing.

A row's key and the number of shards alone decide its shard; no ring or table is kept.  When a
shard is appended, each row either stays or moves into the new shard, and only the necessary
fraction moves.  Rows with one key share a shard; null keys share one as well.  Within a shard
rows get gapless slots, numbered in small buckets whose offsets are summed in two levels, so that
no task ever holds a whole shard.  Ties in the order take slots in any order; an empty table gives
an empty result; columns that clash with the result's names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.llm.common import table, without

SHARDS, BUCKET_ROWS = 16, 128


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hashing (Lamping and Veach) of 64-bit keys, all at once."""
    state = keys.astype(np.uint64)
    at, jump = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    open_ = np.flatnonzero(jump < shards)
    while len(open_):
        at[open_] = jump[open_]
        state[open_] = state[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump[open_] = ((at[open_] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        open_ = open_[jump[open_] < shards]
    return at


def shard_columns(key: Column, shards: int) -> Column:
    """``(shard, grown_shard)`` of a key of any type, for ``shards`` and for one more; equal keys of different integer types go alike."""

    @F.pandas_udf("shard int, grown_shard int")
    def jump(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for keys in batches:
            own = keys.to_numpy(np.int64)
            yield pd.DataFrame({"shard": jump_hash(own, shards).astype(np.int32), "grown_shard": jump_hash(own, shards + 1).astype(np.int32)})

    return jump(F.xxhash64(key.cast("string")))


def gapless_slots(rows: DataFrame, n_rows: int, group: str, order: list[Column], slot: str = "slot", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    A hash of ``order`` deals a group's rows to buckets of about ``bucket_rows``; rows are numbered
    within their bucket and moved by the count of rows in the buckets before.  Buckets are summed in
    runs of about the square root of their number.
    """
    buckets = max(1, math.ceil(n_rows / bucket_rows))
    run = max(1, math.isqrt(buckets))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_r", F.floor(F.col("_b") / run))
    within = Window.partitionBy(group, "_r").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy(group, "_r").agg(F.sum("_n").alias("_m")).withColumn("_o", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    offsets = counts.withColumn("_p", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(runs.drop("_m"), [group, "_r"]).select(group, "_b", (F.col("_p") + F.col("_o")).alias("_p"))
    inside = Window.partitionBy(group, "_b").orderBy(*order)
    return rows.join(offsets, [group, "_b"]).withColumn(slot, (F.col("_p") + F.row_number().over(inside) - 1).cast("long")).drop("_b", "_p")


def assign_shards(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, order: list[str] | None = None) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` and ``grown_shard``, the shard if there were one more."""
    k = F.col(key)
    rows = without(rows, *({"shard", "slot", "grown_shard"} - {key}))
    n = rows.count()
    out = rows.withColumn("_s", shard_columns(k, shards)).select("*", "_s.*").drop("_s")
    return gapless_slots(out, n, "shard", [F.col(c) for c in order or [key]])


def op6_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(docs, "doc_id", SHARDS, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

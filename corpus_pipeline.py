"""From raw documents to training shards: quality, near-duplicates, benchmark leaks, mixing, sharding.

Each stage is written as Parquet to the shared folder and read again by the next, so a lost executor costs at most
the running stage.  All stages but the last return the columns of ``documents``; the last adds ``shard``, ``slot`` and
``grown_shard``.

Documents are near-duplicates at a similarity of 5-word shingle sets of ``NEAR_PERCENT`` or more; the query op9
has 85 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stationwise.llm.common import materialize, table
from stationwise.llm.decontaminate import keep_clean
from stationwise.llm.mixing import mix_documents
from stationwise.llm.near_dup import keep_one
from stationwise.llm.quality import fit_limits, keep_good
from stationwise.llm.sharding import assign_shards

NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, bands=fit_limits(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return assign_shards(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

ORACLE_SQL = None  # compression, signatures, retrieval and random rounding are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

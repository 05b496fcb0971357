"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


@cache
def _own_folder(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary one if all runs on this machine; on a cluster that is an error.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def short_batches(spark: SparkSession) -> SparkSession:
    """Texts can be long: let no more than 1,000 rows at a time go to Python, unless fewer are asked for."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= 1_000:
        spark.conf.set(key, "1000")
    return spark


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage."""
    short_batches(df.sparkSession)
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add; the operator's own columns win."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def row_key(text: str = "text", doc_id: str = "doc_id") -> list:
    """What tells documents apart even where ids repeat or are null: the id and a hash of the text."""
    return [F.col(doc_id).alias("k_id"), F.xxhash64(F.col(text), F.length(text)).alias("k_text")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return short_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of at most so many bytes may be copied to every executor.
COPY_BYTES = 16 << 20


def copied_if_small(table: DataFrame, row_bytes: int, most: int = COPY_BYTES) -> DataFrame:
    """A materialized ``table``, marked for broadcast if its counted rows are few enough; else Spark shuffles."""
    return F.broadcast(table) if table.count() * (row_bytes + 32) <= most else table


def grouped(df: DataFrame, by: str, work: Callable[[int, list[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    """``work(key, rows)`` for the rows of each key, gathered in one task; it gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != held and rows:
                    yield work(held, rows)
                    rows = []
                held = row[0]
                rows.append(row[1:])
        if rows:
            yield work(held, rows)

    return df.repartition(by).sortWithinPartitions(by, *[c for c in df.columns if c != by]).select(by, *[c for c in df.columns if c != by]).mapInArrow(run, schema)

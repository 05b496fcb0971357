"""Parquet footers as a table: what files say about their columns, without a look at a data page.

``parquet_footers`` is a data source whose partitions are groups of files.  It gives a row for each file, row group and
column with the rows, nulls, least and largest value that the writer left in the footer, so it costs a few kilobytes a file
however large the files are.  Statistics that are not there are null.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES_A_TASK = 16
SCHEMA = "file string, row_group int, column string, n_rows long, n_nulls long, least double, most double, least_text string, most_text string, bytes long"


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _number(x) -> float | None:
    """Numbers as they are, times as microseconds since 1970, days as days; no number of anything else."""
    if isinstance(x, (bool, int, float)):
        return float(x)
    if isinstance(x, dt.datetime):
        return float((x.replace(tzinfo=x.tzinfo or dt.timezone.utc) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1))
    return float((x - dt.date(1970, 1, 1)).days) if isinstance(x, dt.date) else None


class FooterReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self) -> list[Files]:
        return [Files(self.files[k : k + FILES_A_TASK]) for k in range(0, len(self.files), FILES_A_TASK)]

    def read(self, partition: Files) -> Iterator[tuple]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for file in partition.files:
            system, path = fs.FileSystem.from_uri(file)
            with system.open_input_file(path) as f:
                footer = pq.read_metadata(f)
            for g in range(footer.num_row_groups):
                group = footer.row_group(g)
                for k in range(group.num_columns):
                    c = group.column(k)
                    s = c.statistics
                    least, most = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
                    texts = (x if isinstance(x, str) else None for x in (least, most))
                    yield file, g, c.path_in_schema, group.num_rows, s.null_count if s is not None and s.has_null_count else None, _number(least), _number(most), *texts, c.total_compressed_size


class ParquetFooters(DataSource):
    """Option ``files``: a JSON list of the files' URIs."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FooterReader:
        return FooterReader(json.loads(self.options["files"]))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """The footers of all Parquet files that Spark finds under ``path``."""
    spark.dataSource.register(ParquetFooters)
    files = sorted(spark.read.parquet(path).inputFiles())
    return spark.read.format("parquet_footers").option("files", json.dumps(files)).load()


def column_statistics(f: DataFrame) -> DataFrame:
    """``(column, n_files, n_groups, n_rows, n_nulls, least, most)``; null where a row group has no such statistics.

    A row group of nulls alone has no least value and does not count for it.
    """
    whole = lambda c, known: F.when(F.count(F.lit(1)) == F.count(F.when(known, 1)), c)
    bound = F.col("least").isNotNull() | (F.col("n_nulls") == F.col("n_rows"))
    return f.groupBy("column").agg(
        F.count_distinct("file").alias("n_files"), F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_rows"),
        whole(F.sum("n_nulls"), F.col("n_nulls").isNotNull()).alias("n_nulls"), whole(F.min("least"), bound).alias("least"), whole(F.max("most"), bound).alias("most"),
    )

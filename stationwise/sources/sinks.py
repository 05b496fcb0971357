"""Where results go: tables as Parquet and CSV, the panel by city, draws by population, and their provenance as JSON.

Folders are written by Spark, wherever they lie; an existing folder is an error unless ``mode`` says otherwise.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_both(df: DataFrame, path: str, keys: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A result as ``path/parquet`` and, with a header, ``path/csv``; one row of each set of ``keys``."""
    rows = df.dropDuplicates(keys) if keys else df
    rows.write.mode(mode).parquet(f"{path}/parquet")
    df.sparkSession.read.parquet(f"{path}/parquet").write.mode(mode).option("header", True).csv(f"{path}/csv")


def write_panel(panel: DataFrame, path: str, by: str = "city", mode: str = "errorifexists") -> DataFrame:
    """The long panel in a folder per city, and its inventory: rows, sensors, first and last day of each."""
    panel.repartition(by).write.mode(mode).partitionBy(by).parquet(f"{path}/panel")
    inventory = panel.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sensor_id").alias("sensors"), F.min("date").alias("first"), F.max("date").alias("last"))
    inventory.coalesce(1).write.mode(mode).option("header", True).csv(f"{path}/inventory")  # a row per city
    return panel.sparkSession.read.parquet(f"{path}/panel")


def write_draws(draws: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> DataFrame:
    """All draws as one dataset with a folder for each value of ``by`` (a population, a strategy)."""
    draws.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)
    return draws.sparkSession.read.parquet(path)


def write_figure_data(df: DataFrame, path: str, names: dict[str, str], mode: str = "errorifexists") -> None:
    """The columns of ``names``, renamed, as CSV."""
    df.select(*[F.col(old).alias(new) for old, new in names.items()]).write.mode(mode).option("header", True).csv(path)


def write_provenance(spark: SparkSession, path: str, about: dict[str, Any], mode: str = "errorifexists") -> None:
    """What made a result (arguments, seeds, hashes of the inputs, duration) as one line of JSON."""
    facts = about | {"spark": spark.version, "application": spark.sparkContext.applicationId}
    spark.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode(mode).text(path)


def read_provenance(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first().value)

"""Checks before and after reading: required tables, complete scans, single rows, canonical slices."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require_tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """All of ``names`` must be readable Parquet tables of ``folder``; the error names those that are not."""
    missing = []
    for name in names:
        try:
            spark.read.parquet(f"{folder}/{name}.parquet")
        except AnalysisException:
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(sorted(missing))}")


def scan_csv(spark: SparkSession, path: str, schema: str, where: Column, keys: DataFrame) -> DataFrame:
    """The rows of a CSV file, with a header, that meet ``where``; each row of ``keys`` must have one.

    The predicate goes to the scan; keys without a row are found by an anti-join.
    """
    rows = spark.read.schema(schema).option("header", True).csv(path).where(where)
    missing = keys.join(rows.select(*keys.columns).distinct(), keys.columns, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"{path} has no rows for {[tuple(r) for r in missing]}")
    return rows


def one_row(df: DataFrame, **values: object) -> dict:
    """The one row with these values, as a dictionary; none and several are errors."""
    for name, value in values.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{'no row' if not rows else 'several rows'} with {values}")
    return rows[0].asDict()


def canonical(df: DataFrame, **allowed: list) -> DataFrame:
    """The rows whose columns have only allowed values (scenarios, estimators, sizes); the filter reaches a Parquet scan."""
    for name, values in allowed.items():
        df = df.where(F.col(name).isin(values))
    return df

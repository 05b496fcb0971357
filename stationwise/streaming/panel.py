"""The panel as it arrives: streaming restatements of daily means, activity sessions and sliding network means.

All take a stream of ``readings`` columns with ``ts`` as a timestamp; late rows beyond the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def reading_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Readings from Parquet files of events as they appear in ``folder``."""
    events = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder).where(F.col("value").isNotNull())
    return events.select(F.col("user_id").cast("string").alias("sensor_id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def without_repeats(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each sensor's first reading of a time."""
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sensor_id", "ts"])


def daily_means(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    day = readings.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "sensor_id")
    return day.agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).select("sensor_id", F.to_date("w.start").alias("date"), "n", (F.col("cents") / F.col("n") / 100).alias("value"))


def sliding_network_mean(readings: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "2 hours") -> DataFrame:
    week = readings.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"))
    return week.agg(F.count(F.lit(1)).alias("n"), (F.sum("cents") / F.count(F.lit(1)) / 100).alias("value")).select(F.to_date("w.start").alias("from_date"), "n", "value")


def activity_sessions(readings: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Stretches of a sensor's readings without a pause of ``gap``; between them lie its gaps."""
    s = readings.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "sensor_id")
    return s.agg(F.count(F.lit(1)).alias("n")).select("sensor_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def outages(readings: DataFrame, silent_hours: int = 24, late: str = "2 hours") -> DataFrame:
    """``(sensor_id, silent_from, silent_to)`` when a sensor speaks again after a silence of ``silent_hours`` or more."""

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = sorted(t for b in batches for t in b["ts"])
        last = pd.Timestamp(state.get[0]) if state.exists else None
        found = []
        for t in times:
            if last is not None and t - last >= pd.Timedelta(hours=silent_hours):
                found.append((key[0], last, t))
            last = t if last is None else max(last, t)
        if last is not None:
            state.update((last.to_pydatetime(),))
        yield pd.DataFrame(found, columns=["sensor_id", "silent_from", "silent_to"])

    keyed = readings.withWatermark("ts", late).groupBy("sensor_id")
    return keyed.applyInPandasWithState(each, "sensor_id string, silent_from timestamp, silent_to timestamp", "last timestamp", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a finite stream gives, from a table in memory; for tests and replays."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

"""The running set of valid sensors: alerts while a sensor is silent, not when it speaks again.

Sensors of a network are dealt to buckets, so that a network of any size is many keys.  A bucket's map state holds the last
reading of each of its sensors; an event-time timer stands at the end of the silence that each may keep, and fires when the
watermark passes it, whether or not anything is ever heard from that sensor again.  State and timers lie in the checkpoint,
so a restarted query reports nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERT = "network string, bucket int, sensor_id string, kind string, silent_from timestamp, at timestamp, n_valid long"
_COLUMNS = [c.split()[0] for c in ALERT.split(", ")]
_ZERO = pd.Timestamp(0)


class ValidSensors(StatefulProcessor):
    """Rows of ``ALERT``: ``up`` for a sensor that joins the set, ``down`` for one that leaves it after ``silent_ms`` of silence."""

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sensors = handle.getMapState("sensors", "sensor_id string", "last long, up boolean")
        self.valid = handle.getValueState("valid", "n long")

    def _change(self, key: tuple, sensor: str, kind: str, last: int | None, at: int) -> tuple:
        n = (self.valid.get()[0] if self.valid.exists() else 0) + (1 if kind == "up" else -1)
        self.valid.update((n,))
        time = lambda ms: None if ms is None else _ZERO + pd.Timedelta(milliseconds=ms)
        return *key, sensor, kind, time(last), time(at), n

    def _heard(self, key: tuple, sensor: str, times: list[int]) -> Iterator[tuple]:
        known = self.sensors.getValue((sensor,)) if self.sensors.containsKey((sensor,)) else None
        first = known[0] if known else None
        last, up = (known[0], known[1]) if known else (None, False)
        for t in times:
            if up and t - last >= self.silent_ms:  # the watermark had not passed its timer yet
                yield self._change(key, sensor, "down", last, last + self.silent_ms)
                up = False
            if not up:
                yield self._change(key, sensor, "up", last, t)
                up = True
            last = t if last is None else max(last, t)
        self.sensors.updateValue((sensor,), (last, up))
        if last != first:
            self.handle.registerTimer(last + self.silent_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        heard: dict[str, list[int]] = {}
        for batch in rows:
            for sensor, ts in zip(batch["sensor_id"], (batch["ts"] - _ZERO) // pd.Timedelta(milliseconds=1), strict=True):
                heard.setdefault(sensor, []).append(int(ts))
        found = [row for sensor in sorted(heard) for row in self._heard(key, sensor, sorted(heard[sensor]))]
        if found:
            yield pd.DataFrame(found, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, silent = expiredTimerInfo.getExpiryTimeInMs(), []
        for sensor, known in self.sensors.iterator():
            if known[1] and known[0] + self.silent_ms <= at:  # one that has spoken since has a later timer
                silent.append((sensor[0], known[0]))
        found = []
        for sensor, last in sorted(silent):
            self.sensors.updateValue((sensor,), (last, False))
            found.append(self._change(key, sensor, "down", last, last + self.silent_ms))
        if found:
            yield pd.DataFrame(found, columns=_COLUMNS)

    def close(self) -> None:
        pass


def sensor_alerts(readings: DataFrame, silent_hours: float = 24, late: str = "2 hours", buckets: int = 64, network: str | None = None) -> DataFrame:
    """Changes of the set of valid sensors of ``readings(sensor_id, ts)``, with the number of those valid in the bucket.

    A sensor is valid from its first reading until it has been silent for ``silent_hours`` of event time.  Null sensors and
    times are passed over.  The session's state store must be RocksDB; it is set if it is not.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    if not (readings.sparkSession.conf.get(key, "") or "").endswith("RocksDBStateStoreProvider"):
        readings.sparkSession.conf.set(key, ROCKSDB)
    known = readings.where(F.col("sensor_id").isNotNull() & F.col("ts").isNotNull())
    name = F.lit("all") if network is None else F.coalesce(F.col(network).cast("string"), F.lit(""))
    keyed = known.select(name.alias("network"), F.pmod(F.xxhash64("sensor_id"), F.lit(buckets)).cast("int").alias("bucket"), "sensor_id", "ts").withWatermark("ts", late)
    return keyed.groupBy("network", "bucket").transformWithStateInPandas(ValidSensors(int(silent_hours * 3_600_000)), ALERT, "Append", "EventTime")

"""Footers without data pages, and alerts that timers give."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stationwise.sources import footers
from stationwise.streaming import alerts


def test_footers_need_no_data_pages(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    for k in range(3):
        ts = [dt.datetime(2024, 1, 1 + k, h) for h in range(20)]
        t = pa.table({"a": pa.array([None if i % 5 == 0 else 100 * k + i for i in range(20)], pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "s": pa.array([f"x{i}" for i in range(20)]), "none": pa.nulls(20, pa.float64())})
        pq.write_table(t, folder / f"part-{k}.parquet", row_group_size=7)
    known = {r["column"]: r for r in footers.column_statistics(footers.footers(spark, str(folder))).collect()}
    a, ts, none = known["a"], known["ts"], known["none"]
    assert (a.n_files, a.n_groups, a.n_rows, a.n_nulls, a.least, a.most) == (3, 9, 60, 12, 1, 219)
    assert ts.n_nulls == 0 and ts.least == dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1e6
    assert (none.n_nulls, none.least, none.most) == (60, None, None)
    texts = footers.footers(spark, str(folder)).where("column = 's'").agg(F.min("least_text"), F.max("most_text")).first()
    assert tuple(texts) == ("x0", "x9")
    for f in folder.iterdir():  # zero all that lies before the footer
        raw = bytearray(f.read_bytes())
        size = int.from_bytes(raw[-8:-4], "little") + 8
        raw[4:-size] = bytes(len(raw) - size - 4)
        f.write_bytes(raw)
    again = {r["column"]: r for r in footers.column_statistics(footers.footers(spark, str(folder))).collect()}
    assert again == known
    with pytest.raises(Exception):
        spark.read.parquet(str(folder)).select("a").collect()


def test_no_statistics_are_null(spark, tmp_path):
    path = tmp_path / "plain.parquet"
    pq.write_table(pa.table({"a": [1, None, 3]}), path, write_statistics=False)
    r = footers.column_statistics(footers.footers(spark, str(path))).first()
    assert (r.n_rows, r.n_nulls, r.least, r.most) == (3, None, None, None)


START = dt.datetime(2024, 3, 1)
READING = "sensor_id string, ts timestamp"


def write(spark, folder, k: int, rows: list[tuple[str, float]]) -> None:
    spark.createDataFrame([(s, START + dt.timedelta(hours=h)) for s, h in rows], READING).coalesce(1).write.parquet(f"{folder}/{k:03d}")


def run(spark, folder, state, out) -> list[tuple]:
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    found = alerts.sensor_alerts(stream, silent_hours=24, late="1 hour", buckets=2)
    q = found.writeStream.format("parquet").option("checkpointLocation", str(state)).option("path", str(out)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    hours = lambda t: None if t is None else (t - START).total_seconds() / 3600
    return [(r.sensor_id, r.kind, hours(r.silent_from), hours(r.at)) for r in spark.read.schema(alerts.ALERT).parquet(str(out)).collect()]


def test_silent_sensor_is_reported_once(spark, tmp_path):
    """``gone`` never speaks again and is reported; ``back`` is reported and returns; ``long`` pauses within one file; a restart repeats nothing."""
    folder, state, out = tmp_path / "in", tmp_path / "state", tmp_path / "out"
    write(spark, folder, 0, [("gone", 0), ("back", 1), ("live", 0), ("live", 10), ("long", 0), ("long", 30)])
    write(spark, folder, 1, [("live", 20), ("live", 40), ("long", 40)])
    write(spark, folder, 2, [("live", 60), ("long", 60)])
    write(spark, folder, 3, [("back", 61), ("live", 62), ("long", 62)])
    want = [
        ("back", "down", 1, 25), ("back", "up", None, 1), ("back", "up", 1, 61), ("gone", "down", 0, 24), ("gone", "up", None, 0),
        ("live", "up", None, 0), ("long", "down", 0, 24), ("long", "up", None, 0), ("long", "up", 0, 30),
    ]
    assert sorted(run(spark, folder, state, out), key=repr) == sorted(want, key=repr)
    assert sorted(run(spark, folder, state, out), key=repr) == sorted(want, key=repr)  # restarted from the checkpoint
    write(spark, folder, 4, [("live", 80), ("long", 80)])
    write(spark, folder, 5, [("live", 100)])
    later = sorted(run(spark, folder, state, out), key=repr)
    assert [r for r in later if r not in want] == [("back", "down", 61, 85)]

"""Readings of a sensor network as a long panel: one row per sensor and time, missing values absent or null.

Values are kept as integer hundredths (``cents``) beside their doubles, so that sums do not depend on the order in
which Spark adds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = ["user_id", "event_type", "ts", "value"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sensor_id, network, city, ts, date, hr, cents)`` from the event table; null values are no readings."""
    e = load(spark, sf_dir, "events").select(*EVENTS).where(F.col("value").isNotNull())
    return e.select(
        F.col("user_id").cast("string").alias("sensor_id"),
        F.col("event_type").alias("network"),
        (F.col("user_id") % 3).alias("city"),
        "ts",
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hr"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def mean(cents: str = "cents") -> Column:
    """The mean of hundredths, in units."""
    return F.sum(cents).cast("double") / F.count(cents) / 100


def daily(r: DataFrame) -> DataFrame:
    """Daily means and valid hours of each sensor."""
    return r.groupBy("sensor_id", "city", "date").agg(F.sum("cents").alias("cents"), F.count("cents").alias("n"), F.expr("bit_count(bit_or(shiftleft(1, hr)))").alias("hours"), mean().alias("value"))


def grid(d: DataFrame) -> DataFrame:
    """Every sensor on every day from the first to the last; ``value`` is null and ``hours`` 0 where a day is missing.

    The days' bounds come from the same small table as the sensors, so that Spark makes it once.
    """
    own = d.groupBy("sensor_id", "city").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    bounds = own.agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))
    days = own.crossJoin(F.broadcast(bounds))  # one row of bounds
    days = days.select("sensor_id", "city", F.explode(F.sequence(F.least("lo", "_lo"), F.greatest("hi", "_hi"))).alias("date"))
    return days.join(d.select("sensor_id", "date", "value", "hours"), ["sensor_id", "date"], "left").withColumn("hours", F.coalesce("hours", F.lit(0)))


def sites(r: DataFrame) -> DataFrame:
    """A place for each sensor, from its number alone."""
    i = F.col("sensor_id").cast("long")
    return r.select("sensor_id", "city").distinct().select("sensor_id", "city", (23.70 + ((i * 7919) % 1000) / 4000).alias("lat"), (90.35 + ((i * 104729) % 1000) / 4000).alias("lon"))


def wide_csv(spark: SparkSession, path: str, sensors: list[str] | None = None) -> DataFrame:
    """A wide matrix, a column per sensor and the time first, as ``(ts, sensor_id, value)``.

    Cells that are no numbers are null.  The zone offset of a time is cut off: times stay local.  Only the columns
    of ``sensors`` are read if they are given; none of them in the file is an error.
    """
    raw = spark.read.csv(path, header=True)
    time, *columns = raw.columns
    known = [c for c in columns if sensors is None or c in set(sensors)]
    if not known:
        raise ValueError(f"no column of {path} is a known sensor")
    ts = F.try_to_timestamp(F.regexp_replace(F.trim(F.col(f"`{time}`")), r"(Z|[+-]\d\d:?\d\d)$", "")).cast("timestamp_ntz")
    long = raw.select(ts.alias("ts"), *[F.col(f"`{c}`") for c in known]).unpivot("ts", [f"`{c}`" for c in known], "sensor_id", "value")
    return long.where(F.col("ts").isNotNull()).withColumn("value", F.expr("try_cast(trim(value) AS double)"))


LOCATIONS = T.StructType([T.StructField("Sensor_ID", T.StringType()), T.StructField("Latitude", T.DoubleType()), T.StructField("Longitude", T.DoubleType()), T.StructField("Station_Name", T.StringType())])


def locations_csv(spark: SparkSession, path: str, exclude_collocated: bool = False) -> DataFrame:
    """Sensor places; a missing station name is the id, a repeated id keeps its first name in order."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    if missing := {"Sensor_ID", "Latitude", "Longitude"} - set(raw.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    name = F.trim("Station_Name") if "Station_Name" in raw.columns else F.lit(None).cast("string")
    out = raw.select(F.trim("Sensor_ID").alias("sensor_id"), F.expr("try_cast(Latitude AS double)").alias("lat"), F.expr("try_cast(Longitude AS double)").alias("lon"), F.coalesce(name, F.trim("Sensor_ID")).alias("station"))
    if exclude_collocated:
        out = out.where(~F.coalesce(F.lower("station").contains("collocation"), F.lit(False)))
    out = out.withColumn("row", F.monotonically_increasing_id())
    first = F.min_by(F.struct("lat", "lon", "station"), "row").alias("p")
    return out.groupBy("sensor_id").agg(first).select("sensor_id", "p.*")


def polygon_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(feature, part, ring, seq, x1, y1, x2, y2)``: the edges of all rings of a GeoJSON file of polygons."""
    ring = "array<array<array<double>>>"
    shape = "features array<struct<geometry: struct<type: string, coordinates: string>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("j"))
    f = raw.select(F.posexplode("j.features").alias("feature", "f")).select("feature", "f.geometry.*")
    parts = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", ring))).otherwise(F.from_json("coordinates", f"array<{ring}>"))
    rings = f.select("feature", F.posexplode(parts).alias("part", "p")).select("feature", "part", F.posexplode("p").alias("ring", "points"))
    ends = F.arrays_zip(F.slice("points", F.lit(1), F.size("points") - 1).alias("a"), F.slice("points", F.lit(2), F.size("points") - 1).alias("b"))
    edges = rings.select("feature", "part", "ring", F.posexplode(ends).alias("seq", "e"))
    return edges.select("feature", "part", "ring", "seq", F.get("e.a", F.lit(0)).alias("x1"), F.get("e.a", F.lit(1)).alias("y1"), F.get("e.b", F.lit(0)).alias("x2"), F.get("e.b", F.lit(1)).alias("y2"))

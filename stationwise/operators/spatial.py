"""Distances between sensors, neighbour graphs, Moran's I, variograms, polygons and hulls.

Pairs are found per city, sensors with the lesser id first.  Neighbour graphs are tables of edges, never matrices.  Within a
radius, sensors are first dealt to cells of that size, so only those of neighbouring cells meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.functions.exprs import DISTANCE_EDGES, EARTH_KM, average_rank, correlation, distance_bin, haversine_km, percent, ratio
from stationwise.operators.cells import k_nearest, points_in, quadrature_points
from stationwise.operators.panel import six
from stationwise.plans.registry import READINGS_SQL, SITES_SQL, query
from stationwise.sources.panel import daily, grid, readings, sites
from stationwise.sources.scratch import written

KM_PER_DEGREE, BAND_KM, NEAREST = 111.19, 5.0, 4

_HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(CAST(1 AS DOUBLE), pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"
KM_SQL = _HAVERSINE.format(a="x", b="y")
PAIRS = f"{SITES_SQL}, p AS (SELECT x.city, x.sensor_id AS a, y.sensor_id AS b, {KM_SQL} AS km FROM site x JOIN site y ON x.city = y.city AND x.id < y.id)"
LINKS = f"{PAIRS}, e AS (SELECT city, a, b, km FROM p WHERE km > 0 AND km <= {BAND_KM} UNION ALL SELECT city, b, a, km FROM p WHERE km > 0 AND km <= {BAND_KM})"


#: Places of a block, and the least blocks of a city, so that there are tasks enough.
PLACES, LEAST_BLOCKS = 1_024, 8


def places(s: DataFrame) -> DataFrame:
    """``(city, lat, lon, sensor_id, n, members)``: where a city has sensors, the least of their ids, and all of them with their numbers."""
    return s.groupBy("city", "lat", "lon").agg(F.min("sensor_id").alias("sensor_id"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct(F.col("sensor_id").cast("long").alias("k"), "sensor_id")).alias("members"))


def place_pairs(s: DataFrame, *columns: str) -> DataFrame:
    """``(city, km)`` and the columns of ``places`` under ``a`` and ``b`` for every two places of a city, and for each with itself.

    Places are dealt to blocks; each pair of blocks is a key of the join, so that all tasks share a city's pairs.
    """
    at = places(s)
    sizes = at.groupBy("city").agg(F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.count(F.lit(1)) / PLACES)).cast("int").alias("blocks"))
    at = at.join(sizes, "city").withColumn("own", F.pmod(F.xxhash64("sensor_id"), F.col("blocks")).cast("int"))
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = list(dict.fromkeys(("sensor_id", "lat", "lon", *columns)))
    named = lambda df, name: df.select("city", "i", "j", *[F.col(c).alias(f"{c}_{name}") for c in keep]).repartition(parts, "city", "i", "j")
    x = named(at.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("blocks") - 1))), "a")
    y = named(at.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own"))), "b")
    both = x.join(y, ["city", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("sensor_id_a") <= F.col("sensor_id_b")))
    return both.withColumn("km", haversine_km("lat_a", "lon_a", "lat_b", "lon_b"))


def pairs(s: DataFrame) -> DataFrame:
    """``(city, a, b, km)`` for every two sensors of a city; a distance is taken once for two places."""
    p = place_pairs(s, "members").withColumn("one", F.col("sensor_id_a") == F.col("sensor_id_b"))
    p = p.select("city", "km", "one", "members_b", F.explode("members_a").alias("x")).select("city", "km", "one", "x", F.explode("members_b").alias("y"))
    first = F.col("x.k") < F.col("y.k")
    p = p.where(first | (~F.col("one") & (F.col("x.k") != F.col("y.k"))))
    return p.select("city", F.when(first, F.col("x.sensor_id")).otherwise(F.col("y.sensor_id")).alias("a"), F.when(first, F.col("y.sensor_id")).otherwise(F.col("x.sensor_id")).alias("b"), "km")


def distances(s: DataFrame) -> DataFrame:
    """``(city, km, n)``: how many pairs of a city's sensors, of two places or of one, are as far apart; a distance may have several rows."""
    one = F.col("sensor_id_a") == F.col("sensor_id_b")
    return place_pairs(s, "n").select("city", "km", F.when(one, F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b")).alias("n")).where("n > 0")


def within(s: DataFrame, km: float) -> DataFrame:
    """The pairs of a city at most ``km`` apart, both ways round, by cells of that size; no distance of 0.

    Sensors of one place have the same links: places meet, and the sensors of those that are linked.
    """
    p = near_places(places(s), km, "members")
    return p.select("city", "km", F.explode("members_a.sensor_id").alias("a"), "members_b").select("city", "a", F.explode("members_b.sensor_id").alias("b"), "km")


def near_places(s: DataFrame, km: float, *columns: str) -> DataFrame:
    """``(city, a, b, km)``, and ``columns`` of both under ``a`` and ``b``: the rows of ``s(city, sensor_id, lat, lon)`` at most ``km`` apart."""
    step = km / KM_PER_DEGREE
    narrow = F.cos(F.radians(F.max(F.abs("lat")).over(Window.partitionBy("city"))))  # so that cells are nowhere narrower than km
    cells = s.select("city", "sensor_id", "lat", "lon", *columns, F.floor(F.col("lat") / step).alias("i"), F.floor(F.col("lon") * narrow / step).alias("j"))
    own, other = (cells.select("city", "i", "j", *[F.col(c).alias(f"{c}_{n}") for c in ("sensor_id", "lat", "lon", *columns)]) for n in "ab")
    for c in "ij":
        other = other.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    met = own.join(other, ["city", "i", "j"]).where(F.col("sensor_id_a") != F.col("sensor_id_b"))
    found = met.select("city", F.col("sensor_id_a").alias("a"), F.col("sensor_id_b").alias("b"), haversine_km("lat_a", "lon_a", "lat_b", "lon_b").alias("km"), *[f"{c}_{n}" for c in columns for n in "ab"])
    found = found.where((F.col("km") > 0) & (F.col("km") <= km))
    if columns:  # rows that come to many more are dealt to all tasks
        found = found.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "city", "a", "b")
    return found


@query(f"WITH {PAIRS} SELECT city, a, b, round(km, 6) AS km FROM p")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(sites(readings(spark, sf_dir))).withColumn("km", six("km"))


@query(f"WITH {LINKS} SELECT city, a, b, round(km, 6) AS km FROM e")
def distance_band_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within(sites(readings(spark, sf_dir)), BAND_KM).withColumn("km", six("km"))


@query(f"WITH {PAIRS}, u AS (SELECT city, a, b, km FROM p UNION ALL SELECT city, b, a, km FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(km, 9), CAST(b AS BIGINT)) AS place FROM u) SELECT city, a, b, CAST(place AS INTEGER) AS place, round(km, 6) AS km FROM k WHERE place <= {NEAREST}")
def nearest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(sites(readings(spark, sf_dir)), NEAREST).withColumn("km", six("km"))


def neighbours(s: DataFrame, k: int) -> DataFrame:
    """``(city, a, b, place, km)``: the ``k`` nearest other sensors of each sensor in its city."""
    a, b = (s.select("city", F.col("sensor_id").alias(n), "lat", "lon") for n in "ab")
    return k_nearest(a, b, k, "city")


_FIRST = f"{PAIRS}, nn AS (SELECT city, a AS sensor_id, min(km) AS km FROM (SELECT city, a, km FROM p UNION ALL SELECT city, b, km FROM p) GROUP BY 1, 2)"


@query(f"WITH {_FIRST} SELECT city, count(*) AS n, round(min(km), 6) AS least, round(median(km), 6) AS median, round(quantile_cont(km, 0.9), 6) AS p90, round(max(km), 6) AS most FROM nn GROUP BY city")
def nearest_neighbour_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a sensor's nearest neighbour is."""
    n = neighbours(sites(readings(spark, sf_dir)), 1)
    q = lambda p: six(F.percentile("km", F.lit(p)))
    return n.groupBy("city").agg(F.count(F.lit(1)).alias("n"), six(F.min("km")).alias("least"), q(0.5).alias("median"), q(0.9).alias("p90"), six(F.max("km")).alias("most"))


_METRICS = ("mean_value", "sd_value", "missing_pct")
_RANKED = lambda c: f"rank() OVER (PARTITION BY city, metric ORDER BY {c}) + (count(*) OVER (PARTITION BY city, metric, {c}) - 1) / CAST(2 AS DOUBLE)"


@query(f"""WITH {READINGS_SQL}, {_FIRST}, u AS (SELECT city, sensor_id, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd_value, round(100 - 100 * count(value) / CAST(count(*) AS DOUBLE), 6) AS missing_pct FROM grid GROUP BY 1, 2),
x AS (SELECT u.city, metric, x, round(km, 6) AS km FROM (UNPIVOT u ON {", ".join(_METRICS)} INTO NAME metric VALUE x) u JOIN nn ON nn.sensor_id = u.sensor_id), k AS (SELECT *, {_RANKED("km")} AS rk, {_RANKED("x")} AS rx FROM x)
SELECT city, metric, count(*) AS n, round(corr(km, x), 6) AS pearson, round(corr(rk, rx), 6) AS spearman FROM k GROUP BY 1, 2""")
def density_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a sensor's distance to its nearest neighbour goes with what it measures and misses."""
    r = readings(spark, sf_dir)
    d = daily(r)
    u = grid(d).groupBy("city", "sensor_id").agg(six(F.avg("value")).alias("mean_value"), six(F.stddev_samp("value")).alias("sd_value"), six(100 - percent(F.count("value"), F.count(F.lit(1)))).alias("missing_pct"))
    near = neighbours(sites(r), 1).select(F.col("a").alias("sensor_id"), six("km").alias("km"))
    x = u.unpivot(["city", "sensor_id"], list(_METRICS), "metric", "x").where("x IS NOT NULL").join(near, "sensor_id")
    k = x.select("city", "metric", "km", "x", average_rank("km", "city", "metric").alias("rk"), average_rank("x", "city", "metric").alias("rx"))
    return k.groupBy("city", "metric").agg(F.count(F.lit(1)).alias("n"), six(correlation("km", "x")).alias("pearson"), six(correlation("rk", "rx")).alias("spearman"))


@query(f"WITH {LINKS}, k AS (SELECT city, a, count(*) AS n FROM e GROUP BY 1, 2) SELECT s.city, count(*) AS n_sensors, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_links, count(CASE WHEN n IS NULL THEN 1 END) AS n_alone, CAST(max(coalesce(n, 0)) AS BIGINT) AS most, round(median(coalesce(n, 0)), 6) AS median FROM site s LEFT JOIN k ON k.a = s.sensor_id GROUP BY s.city")
def link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites(readings(spark, sf_dir))
    k = within(s, BAND_KM).groupBy(F.col("a").alias("sensor_id")).agg(F.count(F.lit(1)).alias("k"))
    n = F.coalesce("k", F.lit(0))
    return s.join(k, "sensor_id", "left").groupBy("city").agg(F.count(F.lit(1)).alias("n_sensors"), F.sum(n).alias("n_links"), F.count_if(F.col("k").isNull()).alias("n_alone"), F.max(n).alias("most"), six(F.percentile(n, F.lit(0.5))).alias("median"))


@query(f"""WITH {READINGS_SQL}, {LINKS}, z AS (SELECT city, date, sensor_id, value - avg(value) OVER (PARTITION BY city, date) AS z FROM d), m AS (SELECT city, date, count(*) AS n, sum(z * z) AS s2, sum(z * z * z * z) AS s4 FROM z GROUP BY 1, 2),
l AS (SELECT zi.city, zi.date, count(*) AS w, sum(zi.z * zj.z) AS num FROM e JOIN z zi ON zi.sensor_id = e.a JOIN z zj ON zj.sensor_id = e.b AND zj.date = zi.date GROUP BY 1, 2)
SELECT m.city, m.date, n, w, round(n / CAST(w AS DOUBLE) * num / s2, 6) AS moran FROM m JOIN l ON l.city = m.city AND l.date = m.date WHERE n >= 3 AND s2 > 0""")
def moran_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moran's I of each day, over the links within the band whose two sensors both have a value."""
    r = readings(spark, sf_dir)
    x = moran_sums(daily(r), sites(r), BAND_KM).where("n >= 3 AND s2 > 0")
    return x.select("city", "date", "n", F.col("s0").alias("w"), six(F.col("n") / F.col("s0") * F.col("num") / F.col("s2")).alias("moran"))


def moran_sums(d: DataFrame, s: DataFrame, km: float) -> DataFrame:
    """``(city, date, n, s2, s4, s0, k2, num)`` of the days with a link: sensors, sums of squares and fourth powers of their deviations ``z``, links both ways round, squares of sensors' links, and the links' products.

    Sensors of one place are not linked and have the same links, so places meet, with their sensors' number and sum of ``z``.
    """
    z = d.select("city", "date", "sensor_id", (F.col("value") - F.avg("value").over(Window.partitionBy("city", "date"))).alias("z"))
    at = places(s).select("city", "lat", "lon", F.col("sensor_id").alias("place"))
    own = s.join(at, ["city", "lat", "lon"]).select("sensor_id", "place")
    power = lambda k: F.sum(F.pow("z", F.lit(k)))
    by_place = z.join(own, "sensor_id", "left").groupBy("city", "date", "place").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("z"), power(2).alias("s2"), power(4).alias("s4"))
    by_place = written(by_place, "places-days")
    m = by_place.groupBy("city", "date").agg(*[F.sum(c).alias(c) for c in ("n", "s2", "s4")])
    e = written(near_places(places(s), km).select("a", "b"), "places-links")
    ends = e.join(by_place.select(F.col("place").alias("a"), "city", "date", "n", "z"), "a").join(by_place.select(F.col("place").alias("b"), "date", F.col("n").alias("nb"), F.col("z").alias("zb")), ["b", "date"])
    g = ends.groupBy("city", "date", "a").agg(F.first("n").alias("n"), F.first("z").alias("z"), F.sum("nb").alias("k"), F.sum("zb").alias("zb"))
    k = F.col("k")
    links = g.groupBy("city", "date").agg(F.sum(F.col("n") * k).alias("s0"), F.sum(F.col("n") * k.cast("double") * k).alias("k2"), F.sum(F.col("z") * F.col("zb")).alias("num"))
    return m.join(links, ["city", "date"])


@query(f"""WITH {READINGS_SQL}, {PAIRS}, v AS (SELECT p.city, p.a, p.b, any_value(km) AS km, count(*) AS n, corr(x.value, y.value) AS r, avg(abs(x.value - y.value)) AS mad, avg((x.value - y.value) * (x.value - y.value)) / 2 AS gamma
FROM p JOIN d x ON x.sensor_id = p.a JOIN d y ON y.sensor_id = p.b AND y.date = x.date GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT city, CAST(CASE WHEN km >= 50 THEN 50 WHEN km >= 20 THEN 20 WHEN km >= 10 THEN 10 WHEN km >= 5 THEN 5 WHEN km >= 2 THEN 2 WHEN km >= 1 THEN 1 ELSE 0 END AS INTEGER) AS from_km, count(*) AS n_pairs, round(median(r), 5) AS median_r, round(median(mad), 5) AS median_abs, round(median(gamma), 5) AS median_gamma FROM v GROUP BY 1, 2""")
def variogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semivariance and correlation of sensor pairs by distance, from the days on which both have a value."""
    r = readings(spark, sf_dir)
    return pair_medians(daily(r), sites(r))


PAIR_BLOCK, MOST_BLOCKS, TILE = 128, 32, 256
#: Pairs whose statistics are rows; beyond that their medians are found by counting.
FEW_PAIRS = 4_000_000
_STATISTICS = ("r", "mad", "gamma")
# Buckets of a count are 1 / 2**14 of a correlation, and 1 / 1,024 of a doubling from 2**-40 to 2**60.
_R_STEPS, _FIRST_BITS, _BUCKETS = 1 << 14, (1023 - 40) << 10, 100 << 10


def pair_statistics(d: DataFrame, s: DataFrame, block: int = PAIR_BLOCK, least: int = 3) -> DataFrame:
    """``(city, a, b, km, n, r, mad, gamma)`` of every two sensors of a city with ``least`` days in common.

    A city's sensors are dealt to blocks of about ``block`` (more, where that would be over ``MOST_BLOCKS``), and each pair of
    blocks is a key: the sensors' days lie in two dense arrays, and the sums over common days are products of tiles of
    these, so no row is made for a pair and a day.
    """
    dealt, kind = _dealt(d, s, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _block_pairs(batches):
            names = np.array(rows.column("sensor_id").to_pylist(), object)
            number = np.array([int(x) for x in names])
            for a, b, keep, km, *numbers in _tiles(rows, least):
                i, j = np.nonzero(keep)
                i, j = a[i], b[j]
                low, high = (np.where((number[i] > number[j]) == swap, j, i) for swap in (True, False))
                city = rows.column("city")[:1].to_pylist() * len(km)
                n, r, mad, gamma = numbers
                columns = [pa.array(city, rows.schema.field("city").type), pa.array(names[low], pa.string()), pa.array(names[high], pa.string()), pa.array(km), pa.array(n.astype(np.int64)), pa.array(r, mask=np.isnan(r)), pa.array(mad), pa.array(gamma)]
                yield pa.RecordBatch.from_arrays(columns, ["city", "a", "b", "km", "n", "r", "mad", "gamma"])

    return dealt.mapInArrow(run, f"city {kind}, a string, b string, km double, n long, r double, mad double, gamma double")


def _dealt(d: DataFrame, s: DataFrame, block: int) -> tuple[DataFrame, str]:
    """Each pair of blocks' sensors with their days, as neighbouring rows of a partition; and the type of ``city``."""
    series = d.groupBy("city", "sensor_id").agg(F.sort_array(F.collect_list(F.struct(F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), "value"))).alias("x"))
    series = series.join(s.select("city", "sensor_id", "lat", "lon"), ["city", "sensor_id"]).select("city", "sensor_id", "lat", "lon", F.col("x.day").alias("days"), F.col("x.value").alias("values"))
    sizes = s.groupBy("city").agg(F.least(F.lit(MOST_BLOCKS), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))  # a row per city
    series = series.join(sizes, "city").withColumn("block", F.pmod(F.xxhash64("sensor_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = series.select("city", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "sensor_id", "lat", "lon", "days", "values")
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "city", "i", "j").sortWithinPartitions("city", "i", "j", "side", "sensor_id"), d.schema["city"].dataType.simpleString()


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        of = list(zip(*(batch.column(c).to_pylist() for c in ("city", "i", "j")), strict=True))
        cuts = [0, *(k for k in range(1, len(of)) if of[k] != of[k - 1]), len(of)]
        for first, last in zip(cuts, cuts[1:], strict=False):
            if first == last:
                continue
            if held and of[first] != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = of[first]
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tiles(rows: pa.Table, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(a, b, keep, km, n, r, mad, gamma)`` of a tile: its rows, the pairs of them that count, and what is known of each of these; ``r`` is no number without variance."""
    of_row = np.repeat(np.arange(rows.num_rows), rows.column("days").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
    days, at = np.unique(rows.column("days").combine_chunks().flatten().to_numpy(), return_inverse=True)
    value, there = np.zeros((rows.num_rows, len(days))), np.zeros((rows.num_rows, len(days)))
    value[of_row, at], there[of_row, at] = rows.column("values").combine_chunks().flatten().to_numpy(), 1.0
    first = rows.column("side").to_numpy() == 0
    own = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
    number = np.array([int(x) for x in rows.column("sensor_id").to_pylist()])
    lat, lon = (np.radians(rows.column(c).to_numpy()) for c in ("lat", "lon"))
    left, right = (np.arange(rows.num_rows),) * 2 if own else (np.flatnonzero(first), np.flatnonzero(~first))
    for k in range(0, len(left), TILE):
        for m in range(k if own else 0, len(right), TILE):
            a, b = left[k : k + TILE], right[m : m + TILE]
            va, vb, ta, tb = value[a], value[b], there[a], there[b]
            n = ta @ tb.T
            keep = n >= least
            if own and k == m:
                keep &= a[:, None] < b[None, :]
            keep &= number[a][:, None] != number[b][None, :]
            if not keep.any():
                continue
            sa, sb, saa, sbb, sab = va @ tb.T, ta @ vb.T, (va * va) @ tb.T, ta @ (vb * vb).T, va @ vb.T
            # differences of all days, where a missing value is 0, less the days that one of both lacks
            off, gap = np.zeros_like(n), np.empty_like(n)
            for x, y in zip(np.ascontiguousarray(va.T), np.ascontiguousarray(vb.T), strict=True):
                np.subtract(x[:, None], y[None, :], out=gap)
                np.abs(gap, out=gap)
                off += gap
            wa, wb = np.abs(va), np.abs(vb)
            off += wa @ tb.T - wa.sum(1)[:, None]
            off += ta @ wb.T - wb.sum(1)[None, :]
            np.maximum(off, 0, out=off)
            h = np.sin((lat[b][None, :] - lat[a][:, None]) / 2) ** 2 + np.cos(lat[a])[:, None] * np.cos(lat[b])[None, :] * np.sin((lon[b][None, :] - lon[a][:, None]) / 2) ** 2
            all_ = bool(keep.all())
            c, x, y, xx, yy, xy, off, h = ((z.reshape(-1) if all_ else z[keep]) for z in (n, sa, sb, saa, sbb, sab, off, h))
            km = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h)))
            x, y, xx, yy, xy = x / c, y / c, xx / c, yy / c, xy / c
            spread = np.sqrt(np.maximum(0, xx - x * x) * np.maximum(0, yy - y * y))
            r = np.divide(xy - x * y, spread, out=np.full(len(c), np.nan), where=spread > 1e-12)
            yield a, b, keep, km, c, r, off / c, (xx - 2 * xy + yy) / 2


def pair_medians(d: DataFrame, s: DataFrame, block: int = PAIR_BLOCK, few: int = FEW_PAIRS, least: int = 3) -> DataFrame:
    """``(city, from_km, n_pairs, median_r, median_abs, median_gamma)``, exact: the medians of ``pair_statistics`` by distance.

    Up to ``few`` pairs are rows.  More are gone through twice: tasks count them in fixed buckets, then give the values in the
    buckets that hold the medians, equal ones once, so that memory and disk don't grow with the pairs.
    """
    pairs_ = s.groupBy("city").count().agg(F.sum(F.col("count").cast("double") * F.col("count") / 2)).first()[0] or 0
    if pairs_ <= few:
        v = pair_statistics(d, s, block, least)
        q = lambda c: F.round(F.percentile(c, F.lit(0.5)), 5)
        return v.groupBy("city", distance_bin("km").alias("from_km")).agg(F.count(F.lit(1)).alias("n_pairs"), q("r").alias("median_r"), q("mad").alias("median_abs"), q("gamma").alias("median_gamma"))
    dealt, kind = _dealt(written(d.select("city", "sensor_id", "date", "value"), "pair-days"), s, block)
    names = ["city", "from_km", "statistic", "bucket", "value", "n"]
    schema = f"city {kind}, from_km int, statistic int, bucket int, value double, n long"

    def batch_of(city: object, kind_: pa.DataType, edge: np.ndarray, statistic: int, bucket: np.ndarray, value: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        k = len(n)
        return pa.RecordBatch.from_arrays([pa.array([city] * k, kind_), pa.array(edge.astype(np.int32)), pa.array(np.full(k, statistic, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(value.astype(float)), pa.array(n.astype(np.int64))], names)

    packed, found_ = f"city {kind}, from_km int, statistic int, at binary, n binary", f"city {kind}, from_km int, statistic int, n long, k long, bucket int, below long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        city, kind_, held = None, None, None

        def close() -> pa.RecordBatch:
            rows = []
            for statistic, counts in enumerate(held):
                for edge, own in zip(DISTANCE_EDGES, counts, strict=True):
                    if len(at := np.flatnonzero(own)):
                        rows.append((city, edge, statistic, at.astype("<i4").tobytes(), own[at].astype("<i8").tobytes()))
            kinds = (kind_, pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["city", "from_km", "statistic", "at", "n"])

        for rows in _block_pairs(batches):
            if (now := rows.column("city")[0].as_py()) != city or held is None:
                if held is not None:
                    yield close()
                city, kind_, held = now, rows.schema.field("city").type, [np.zeros((len(DISTANCE_EDGES), 2 + _BUCKETS), np.int64) for _ in _STATISTICS]
            for *_, km, _, r, mad, gamma in _tiles(rows, least):
                edge = np.searchsorted(DISTANCE_EDGES, km, side="right") - 1
                for statistic, (counts, x) in enumerate(zip(held, (r, mad, gamma), strict=True)):  # values that are no numbers come before all buckets
                    np.add.at(counts.reshape(-1), edge * counts.shape[1] + 1 + _bucket(statistic, x), 1)
        if held is not None:
            yield close()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, kind_ = None, None, None

        def close() -> pa.RecordBatch:
            k, upto, rows = int(total[1:].sum()), np.cumsum(total[1:]), []
            for bucket in sorted({int(np.searchsorted(upto, place, side="right")) for place in ((k - 1) // 2, k // 2)}) if k else [-2]:
                rows.append((*key, int(total.sum()), k, bucket, int(upto[bucket] - total[1 + bucket]) if k else 0))
            kinds = (kind_, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["city", "from_km", "statistic", "n", "k", "bucket", "below"])

        for batch in batches:
            for row in batch.to_pylist():
                if (now := (row["city"], row["from_km"], row["statistic"])) != key:
                    if key is not None:
                        yield close()
                    key, total, kind_ = now, np.zeros(2 + _BUCKETS, np.int64), batch.schema.field("city").type
                total[np.frombuffer(row["at"], "<i4")] += np.frombuffer(row["n"], "<i8")
        if key is not None:
            yield close()

    group = ["city", "from_km", "statistic"]
    middle = written(dealt.mapInArrow(count, packed).repartition(*group).sortWithinPartitions(*group).mapInArrow(merge, found_), "pair-middles")
    low, high = F.expr("(k - 1) div 2"), F.expr("k div 2")
    sought: dict[tuple, set[int]] = {}
    for row in middle.collect():  # at most two buckets for each city, distance and statistic
        sought.setdefault((row.city, row.from_km, row.statistic), set()).add(row.bucket)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _block_pairs(batches):
            city = rows.column("city")[0].as_py()
            wanted = [np.array([[bucket[0], bucket[-1]] for e in DISTANCE_EDGES for bucket in [sorted(sought.get((city, e, statistic), {-2}))]]) for statistic in range(len(_STATISTICS))]
            for *_, km, _, r, mad, gamma in _tiles(rows, least):
                edge = np.searchsorted(DISTANCE_EDGES, km, side="right") - 1
                for statistic, x in enumerate((r, mad, gamma)):
                    bucket = _bucket(statistic, x)
                    hit = np.flatnonzero((bucket == wanted[statistic][edge, 0]) | (bucket == wanted[statistic][edge, 1]))
                    if len(hit):
                        (e, b, v), n = np.unique(np.stack([edge[hit], bucket[hit], x[hit]]), axis=1, return_counts=True)
                        yield batch_of(city, rows.schema.field("city").type, np.array(DISTANCE_EDGES)[e.astype(int)], statistic, b, v, n)

    values = dealt.mapInArrow(pick, schema).groupBy(*group, "bucket", "value").agg(F.sum("n").alias("n"))
    values = values.join(F.broadcast(middle.drop("n")), [*group, "bucket"])
    place = F.col("below") + F.sum("n").over(Window.partitionBy(*group, "bucket").orderBy("value")) - F.col("n")
    values = values.withColumn("place", place)
    at = lambda p, k: F.max(F.when((F.col("statistic") == k) & (F.col("place") <= p) & (F.col("place") + F.col("n") > p), F.col("value")))
    medians = values.groupBy("city", "from_km").agg(*[F.struct(at(low, k).alias("lo"), at(high, k).alias("hi")).alias(name) for k, name in enumerate(_STATISTICS)])
    half = lambda c: F.round((F.col(f"{c}.lo") + F.col(f"{c}.hi")) / 2, 5)
    whole = middle.where("statistic = 1").groupBy("city", "from_km").agg(F.max("n").alias("n_pairs"))
    return whole.join(medians, ["city", "from_km"], "left").select("city", "from_km", "n_pairs", half("r").alias("median_r"), half("mad").alias("median_abs"), half("gamma").alias("median_gamma"))


def _bucket(statistic: int, x: np.ndarray) -> np.ndarray:
    """Buckets of values in their order; -1 for what is no number."""
    if statistic == 0:
        return np.where(np.isnan(x), -1, np.clip(np.floor((np.nan_to_num(x) + 1) * _R_STEPS), 0, _BUCKETS)).astype(np.int64)
    return np.clip((np.maximum(x, 0.0).view(np.int64) >> 42) - _FIRST_BITS, 0, _BUCKETS)


# A closed ring with a notch, within the sensors' area: (lon, lat).
RING = ((90.37, 23.72), (90.55, 23.72), (90.55, 23.90), (90.46, 23.78), (90.37, 23.90), (90.37, 23.72))
_EDGES = list(zip(RING, RING[1:], strict=False))


@query(f"WITH {SITES_SQL}, g(x1, y1, x2, y2) AS (VALUES {', '.join(f'(CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))' for a, b in _EDGES)}), k AS (SELECT sensor_id, count(*) AS n FROM site JOIN g ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 GROUP BY 1) SELECT s.city, s.sensor_id FROM site s JOIN k USING (sensor_id) WHERE n % 2 = 1")
def sensors_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites(readings(spark, sf_dir))
    return s.join(points_in(s, ring(spark), "lon", "lat", "sensor_id", RING_STEP), "sensor_id", "left_semi").select("city", "sensor_id")


def in_polygon(points: DataFrame, edges: DataFrame, x: str, y: str, key: str, cells: int = 64) -> DataFrame:
    """The points inside a polygon given as edges ``(x1, y1, x2, y2)``, by about ``cells`` cells along its longer side."""
    box = edges.agg(*[(F.max(F.greatest(f"{c}1", f"{c}2")) - F.min(F.least(f"{c}1", f"{c}2"))).alias(c) for c in "xy"]).first()
    step = max(box.x or 0.0, box.y or 0.0) / cells or 1.0
    return points.join(points_in(points, edges.withColumn("poly", F.lit(0)), x, y, key, step).select(key), key, "left_semi")


RING_STEP, RING_SIDE = 0.02, 4


def ring(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, *a, *b) for a, b in _EDGES], "poly int, x1 double, y1 double, x2 double, y2 double")


_RING_SQL = f"g(x1, y1, x2, y2) AS (VALUES {', '.join(f'(CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))' for a, b in _EDGES)})"
_INSIDE = "(y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / nullif(y2 - y1, 0) + x1"


@query(f"""WITH {SITES_SQL}, {_RING_SQL}, q AS (SELECT gx, gy, (gx + 0.5::DOUBLE) * CAST({RING_STEP / RING_SIDE!r} AS DOUBLE) AS x, (gy + 0.5::DOUBLE) * CAST({RING_STEP / RING_SIDE!r} AS DOUBLE) AS y FROM range(18060, 18130) AS a(gx), range(4730, 4790) AS b(gy)), i AS (SELECT gx, gy, x, y FROM q JOIN g ON {_INSIDE.format(x="x", y="y")} GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1)
SELECT s.city, count(*) AS n_points, round(avg(km), 6) AS mean_km, round(max(km), 6) AS max_km FROM (SELECT city, gx, gy, min({_HAVERSINE.format(a="site", b="z")}) AS km FROM site CROSS JOIN (SELECT gx, gy, x AS lon, y AS lat FROM i) z GROUP BY 1, 2, 3) s GROUP BY 1""")
def quadrature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the points of a grid within the ring are from the nearest sensor of each city."""
    s = sites(readings(spark, sf_dir))
    q = quadrature_points(ring(spark), RING_STEP, RING_SIDE).select(F.concat_ws("|", "gx", "gy").alias("a"), F.col("y").alias("lat"), F.col("x").alias("lon"))
    every = s.select("city").distinct().join(q)  # a fixed grid for each city
    near = k_nearest(every, s.select("city", F.col("sensor_id").alias("b"), "lat", "lon"), 1, "city")
    return near.groupBy("city").agg(F.count(F.lit(1)).alias("n_points"), six(F.avg("km")).alias("mean_km"), six(F.max("km")).alias("max_km"))


@query(f"""WITH {SITES_SQL}, {_RING_SQL}, i AS (SELECT sensor_id FROM site JOIN g ON {_INSIDE.format(x="lon", y="lat")} GROUP BY 1 HAVING count(*) % 2 = 1), v AS (SELECT DISTINCT x1 AS lon, y1 AS lat FROM g), n AS (SELECT city, sensor_id, min({_HAVERSINE.format(a="site", b="v")}) AS km FROM site CROSS JOIN v GROUP BY 1, 2),
m AS (SELECT city, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon FROM site GROUP BY 1), c AS (SELECT site.city, sensor_id, id, round({_HAVERSINE.format(a="site", b="m")}, 6) AS km FROM site JOIN m ON m.city = site.city), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY city ORDER BY km DESC, id) = 1)
SELECT f.city, f.sensor_id AS farthest, f.km AS farthest_km, o.n_outside, o.nearest_vertex_km, o.farthest_vertex_km FROM f JOIN (SELECT n.city, count(CASE WHEN i.sensor_id IS NULL THEN 1 END) AS n_outside, round(min(km), 6) AS nearest_vertex_km, round(max(km), 6) AS farthest_vertex_km FROM n LEFT JOIN i ON i.sensor_id = n.sensor_id GROUP BY 1) o ON o.city = f.city""")
def coverage_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By city: the sensor farthest from the centre, the sensors outside the ring, and how near sensors come to its corners."""
    s = sites(readings(spark, sf_dir))
    centre = s.groupBy("city").agg(F.round(F.avg("lat"), 9).alias("clat"), F.round(F.avg("lon"), 9).alias("clon"))
    far = s.join(centre, "city").withColumn("km", six(haversine_km("lat", "lon", "clat", "clon")))
    far = far.groupBy("city").agg(F.max_by(F.struct(F.col("sensor_id").alias("farthest"), F.col("km").alias("farthest_km")), F.struct("km", -F.col("sensor_id").cast("long"))).alias("f")).select("city", "f.*")
    inside = points_in(s, ring(spark), "lon", "lat", "sensor_id", RING_STEP).select("sensor_id", F.lit(1).alias("_in"))
    corners = ring(spark).select(F.col("y1").alias("lat"), F.col("x1").alias("lon")).distinct().withColumn("b", F.concat_ws("|", "lat", "lon"))
    near = k_nearest(s.select(F.lit(0).alias("g"), F.col("sensor_id").alias("a"), "lat", "lon"), corners.withColumn("g", F.lit(0)), 1, "g").select(F.col("a").alias("sensor_id"), "km")
    outside = s.join(near, "sensor_id").join(inside, "sensor_id", "left").groupBy("city").agg(F.count_if(F.col("_in").isNull()).alias("n_outside"), six(F.min("km")).alias("nearest_vertex_km"), six(F.max("km")).alias("farthest_vertex_km"))
    return far.join(outside, "city")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise from the leftmost point, without points on its edges."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(order):
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(reversed(points))


def hulls(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """``(group, seq, x, y)``: the hull of each group.  Partial hulls come first, so a group is never gathered whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[float, float]]] = {}
        for batch in batches:
            for g, px, py in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = held.setdefault(g, [])
                own.append((px, py))
                if len(own) > 10_000:
                    held[g] = hull(own)
        rows = [(g, i, *p) for g, own in held.items() for i, p in enumerate(hull(own))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["g", "seq", "x", "y"])

    schema = "g long, seq int, x double, y double"
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).cast("long").alias("g"), F.col(x).alias("x"), F.col(y).alias("y"))
    part = known.mapInArrow(run, schema).select("g", "x", "y")
    return part.repartition("g").mapInArrow(run, schema).withColumnRenamed("g", group)


@query()
def city_hull_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each city's hull in square kilometres, by the shoelace formula on a local plane."""
    s = sites(readings(spark, sf_dir))
    w = Window.partitionBy("city")
    flat = s.select("city", (F.col("lon") * 111.320 * F.cos(F.radians(F.avg("lat").over(w)))).alias("x"), (F.col("lat") * 110.574).alias("y"))
    ring = Window.partitionBy("city").orderBy("seq")
    h = hulls(flat, "city", "x", "y")
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(ring))
    turn = h.select("city", (F.col("x") * nxt("y") - nxt("x") * F.col("y")).alias("t"))
    return turn.groupBy("city").agg(F.count(F.lit(1)).alias("n_corners"), six(F.abs(F.sum("t")) / 2).alias("km2"))


@query(f"""WITH {READINGS_SQL}, {SITES_SQL}, g AS (SELECT gx, gy, 90.35 + gx * CAST(0.05 AS DOUBLE) AS lon, 23.70 + gy * CAST(0.05 AS DOUBLE) AS lat FROM range(0, 6) AS a(gx), range(0, 6) AS b(gy)), o AS (SELECT city, gx, gy, sensor_id, row_number() OVER (PARTITION BY city, gx, gy ORDER BY round(pow(site.lat - g.lat, 2) + pow(site.lon - g.lon, 2), 12), id) AS k FROM site CROSS JOIN g),
w AS (SELECT city, sensor_id, count(*) / CAST(36 AS DOUBLE) AS w FROM o WHERE k = 1 GROUP BY 1, 2) SELECT d.city, d.date, round(sum(w.w * d.value) / sum(w.w), 6) AS weighted, round(pow(sum(w.w), 2) / sum(w.w * w.w), 6) AS n_effective FROM d JOIN w ON w.sensor_id = d.sensor_id GROUP BY 1, 2""")
def area_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means with weights by the grid points that each sensor is nearest to."""
    r = readings(spark, sf_dir)
    s = sites(r)
    points = s.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(5))))
    d2 = F.round(F.pow(F.col("lat") - (23.70 + F.col("gy") * 0.05), F.lit(2)) + F.pow(F.col("lon") - (90.35 + F.col("gx") * 0.05), F.lit(2)), 12)
    own = points.groupBy("city", "gx", "gy").agg(F.min_by("sensor_id", F.struct(d2, F.col("sensor_id").cast("long"))).alias("sensor_id"))
    w = own.groupBy("sensor_id").agg((F.count(F.lit(1)) / 36).alias("w"))
    j = daily(r).join(w, "sensor_id")
    return j.groupBy("city", "date").agg(six(ratio(F.sum(F.col("w") * F.col("value")), F.sum("w"))).alias("weighted"), six(ratio(F.pow(F.sum("w"), F.lit(2)), F.sum(F.col("w") * F.col("w")))).alias("n_effective"))

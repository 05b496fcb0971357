"""Permutation tests, cross-validated regression, silhouettes, nested convergence and sensor placement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.functions.exprs import EARTH_KM, haversine_km, ratio
from stationwise.functions.md5 import Texts
from stationwise.operators.panel import six
from stationwise.operators.sampling import _median_error, drawn_sql, period, simulate
from stationwise.operators.spatial import _HAVERSINE, BAND_KM, LINKS
from stationwise.plans.registry import READINGS_SQL, SITES_SQL, query
from stationwise.sources.panel import daily, grid, readings, sites
from stationwise.sources.scratch import written

PERMUTATIONS, FOLDS, DESIGN = 199, 5, 6


@query(f"""WITH {READINGS_SQL}, {LINKS}, z AS (SELECT city, date, sensor_id, value - avg(value) OVER (PARTITION BY city, date) AS z, row_number() OVER (PARTITION BY city, date ORDER BY sensor_id) AS place FROM d),
t AS (SELECT city, date, count(*) AS n, sum(z * z) AS s2 FROM z GROUP BY 1, 2), a AS (SELECT z.*, CAST(perm AS INTEGER) AS perm, row_number() OVER (PARTITION BY city, date, perm ORDER BY CASE WHEN perm = 0 THEN '' ELSE md5(perm || '|' || date || '|' || sensor_id) END, sensor_id) AS from_place FROM z CROSS JOIN range(0, {PERMUTATIONS + 1}) AS r(perm)),
v AS (SELECT a.city, a.date, a.perm, a.sensor_id, z.z FROM a JOIN z ON z.city = a.city AND z.date = a.date AND z.place = a.from_place), m AS (SELECT x.city, x.date, x.perm, sum(x.z * y.z) / count(*) AS s FROM e JOIN v x ON x.sensor_id = e.a JOIN v y ON y.sensor_id = e.b AND y.date = x.date AND y.perm = x.perm GROUP BY 1, 2, 3),
i AS (SELECT m.city, m.date, perm, round(t.n * s / s2, 9) AS i FROM m JOIN t ON t.city = m.city AND t.date = m.date WHERE t.n >= 3 AND s2 > 0), o AS (SELECT city, date, i AS own FROM i WHERE perm = 0)
SELECT o.city, o.date, round(max(own), 6) AS moran, count(*) AS n_permutations, round((1 + sum(CASE WHEN i.i >= own THEN 1 ELSE 0 END)) / CAST(1 + count(*) AS DOUBLE), 6) AS p_upper FROM o JOIN i ON i.city = o.city AND i.date = o.date WHERE perm > 0 GROUP BY 1, 2""")
def moran_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moran's I of each day against values dealt anew to the day's sensors, in orders that hashes give."""
    r = readings(spark, sf_dir)
    days = daily(r).select("city", "date", "sensor_id", "value").join(sites(r).select("sensor_id", "lat", "lon"), "sensor_id", "left")
    return permuted_moran(days)


PLACE_BLOCK = 512


def permuted_moran(days: DataFrame, permutations: int = PERMUTATIONS, km: float = BAND_KM) -> DataFrame:
    """``(city, date, moran, n_permutations, p_upper)`` of ``days(city, date, sensor_id, value, lat, lon)``.

    A day's sensors stream to one task as rows.  Those of one place have the same links, so a permutation is the sums of
    its values by place, and the links are found block by block of places and not kept.
    """
    kind = days.schema["city"].dataType.simpleString()
    columns = ("city", "date", "sensor_id", "value", "lat", "lon")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for city, date, rows in _days_of(batches):
            z = rows.column("value").to_numpy()
            if len(z) >= 3 and (found := _permuted(rows.column("sensor_id").to_pylist(), z, rows, date, permutations, km)) is not None:
                out = (city, date, *found)
                kinds = [rows.schema.field("city").type, pa.date32(), pa.float64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds, strict=True)], ["city", "date", "moran", "n_permutations", "p_upper"])

    dealt = days.select(*columns).repartition(int(days.sparkSession.conf.get("spark.sql.shuffle.partitions")), "city", "date")
    return dealt.sortWithinPartitions("city", "date", "sensor_id").mapInArrow(run, f"city {kind}, date date, moran double, n_permutations long, p_upper double")


def _days_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, object, pa.Table]]:
    """The rows of each city and date, from batches in their order."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        of = list(zip(batch.column("city").to_pylist(), batch.column("date").to_pylist(), strict=True))
        cuts = [0, *(k for k in range(1, len(of)) if of[k] != of[k - 1]), len(of)]
        for first, last in zip(cuts, cuts[1:], strict=False):
            if held and of[first] != key:
                yield *key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = of[first]
            held.append(batch.slice(first, last - first))
    if held:
        yield *key, pa.Table.from_batches(held).combine_chunks()


def _permuted(names: list[str], values: np.ndarray, rows: pa.Table, date: object, permutations: int, km: float) -> tuple[float, int, float] | None:
    z = values - values.mean()
    s2 = float(z @ z)
    if not s2 > 0:
        return None
    places, of = np.unique(np.column_stack([rows.column(c).to_numpy() for c in ("lat", "lon")]), axis=0, return_inverse=True)
    of = of.reshape(-1)
    texts, sums = Texts(names), np.empty((1 + permutations, len(places)))
    sums[0] = np.bincount(of, z, len(places))
    for perm in range(1, permutations + 1):
        high, low = texts.digests(f"{perm}|{date}|")
        order = np.argsort(high, kind="stable")
        if (high[order[1:]] == high[order[:-1]]).any():
            order = np.lexsort((low, high))
        dealt = np.empty(len(z))
        dealt[order] = z  # the sensor that comes k-th by its hash gets the k-th sensor's value
        sums[perm] = np.bincount(of, dealt, len(places))
    here, total, links = np.bincount(of, minlength=len(places)).astype(float), np.zeros(1 + permutations), 0.0
    lat, lon = np.radians(places[:, 0]), np.radians(places[:, 1])
    for k in range(0, len(places), PLACE_BLOCK):
        some = slice(k, k + PLACE_BLOCK)
        h = np.sin((lat[None, :] - lat[some, None]) / 2) ** 2 + np.cos(lat[some, None]) * np.cos(lat[None, :]) * np.sin((lon[None, :] - lon[some, None]) / 2) ** 2
        far = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h)))
        linked = ((far > 0) & (far <= km)).astype(float)  # no place is known: no link
        total += ((sums[:, some] @ linked) * sums).sum(1)
        links += float((here[some] @ linked) @ here)
    if not links:
        return None
    i = np.round(len(z) * (total / links) / s2, 9)
    return round(float(i[0]), 6), permutations, round((1 + int((i[1:] >= i[0]).sum())) / (1 + permutations), 6)


@query(f"""WITH {READINGS_SQL}, n AS (SELECT city, date, ln(1 + avg(value)) AS y, 1 - count(value) / CAST(count(*) AS DOUBLE) AS x, CAST('0x' || substr(md5(city || '|' || date), 1, 6) AS BIGINT) % {FOLDS} AS fold FROM grid GROUP BY 1, 2 HAVING count(value) > 0),
f AS (SELECT city, fold, count(*) AS k, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM n GROUP BY 1, 2), t AS (SELECT city, sum(k) AS k, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM f GROUP BY 1),
c AS (SELECT f.city, f.fold, t.k - f.k AS k, t.sx - f.sx AS sx, t.sy - f.sy AS sy, t.sxx - f.sxx AS sxx, t.sxy - f.sxy AS sxy FROM f JOIN t ON t.city = f.city), b AS (SELECT 1), g AS (SELECT city, fold, (k * sxy - sx * sy) / (k * sxx - sx * sx) AS slope, sx, sy, k FROM c WHERE k * sxx - sx * sx > 1e-12),
p AS (SELECT n.city, y, (sy - slope * sx) / g.k + slope * x AS fit FROM n JOIN g ON g.city = n.city AND g.fold = n.fold) SELECT city, count(*) AS n, round(sqrt(avg((y - fit) * (y - fit))), 6) AS rmse, round(avg(abs(y - fit)), 6) AS mae, round(1 - sum((y - fit) * (y - fit)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0), 5) AS r2 FROM p GROUP BY city""".replace(" b AS (SELECT 1),", ""))
def ols_cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log daily means on the share of missing sensors; each fold is predicted from the sums of the other folds."""
    n = grid(daily(readings(spark, sf_dir))).groupBy("city", "date").agg(F.log1p(F.avg("value")).alias("y"), (1 - ratio(F.count("value"), F.count(F.lit(1)))).alias("x"), F.count("value").alias("seen")).where("seen > 0")
    key = F.md5(F.concat_ws("|", F.col("city").cast("string"), F.col("date").cast("string")))
    n = n.withColumn("fold", F.conv(F.substring(key, 1, 6), 16, 10).cast("long") % FOLDS)
    x, y = F.col("x"), F.col("y")
    names = ("k", "sx", "sy", "sxx", "sxy")
    f = n.groupBy("city", "fold").agg(*[c.alias(k) for k, c in zip(names, (F.count(x), F.sum(x), F.sum(y), F.sum(x * x), F.sum(x * y)), strict=True)])
    w = Window.partitionBy("city")
    f = f.select("city", "fold", *[(F.sum(k).over(w) - F.col(k)).alias(k) for k in names])
    spread = F.col("k") * F.col("sxx") - F.col("sx") * F.col("sx")
    g = f.where(spread > 1e-12).withColumn("slope", (F.col("k") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread)
    p = n.join(g, ["city", "fold"]).withColumn("off", y - ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("k") + F.col("slope") * x))
    o = F.col("off")
    total = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return p.groupBy("city").agg(F.count(o).alias("n"), six(F.sqrt(F.avg(o * o))).alias("rmse"), six(F.avg(F.abs(o))).alias("mae"), F.round(1 - ratio(F.sum(o * o), total), 5).alias("r2"))


@query(f"""WITH {READINGS_SQL}, q AS (SELECT sensor_id, city, avg(value) AS m, stddev_samp(value) AS s FROM d GROUP BY 1, 2 HAVING count(*) > 1), c AS (SELECT x.sensor_id, x.city, y.city AS other, sum(sqrt(pow(x.m - y.m, 2) + pow(x.s - y.s, 2))) AS t, count(*) AS k FROM q x JOIN q y ON x.sensor_id <> y.sensor_id GROUP BY 1, 2, 3),
o AS (SELECT sensor_id, city, max(CASE WHEN city = other THEN t / k END) AS a, min(CASE WHEN city <> other THEN t / k END) AS b FROM c GROUP BY 1, 2) SELECT city, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM o GROUP BY city""")
def city_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well cities part the sensors by mean and spread: silhouettes by Euclidean distance."""
    q = daily(readings(spark, sf_dir)).groupBy("sensor_id", "city").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where("s IS NOT NULL")
    c = city_distances(q).groupBy("sensor_id", "city", "other").agg((F.sum("total") / F.sum("k")).alias("t"))
    own = F.col("city") == F.col("other")
    o = c.groupBy("sensor_id", "city").agg(F.max(F.when(own, F.col("t"))).alias("a"), F.min(F.when(~own, F.col("t"))).alias("b"))
    return o.groupBy("city").agg(F.count(F.lit(1)).alias("n"), six(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


DISTANCE_BLOCK = 1_024


def city_distances(q: DataFrame, block: int = DISTANCE_BLOCK) -> DataFrame:
    """``(sensor_id, city, other, total, k)``: each sensor's distances to the others of each city, summed block by block of ``q(sensor_id, city, m, s)``."""
    kind = q.schema["city"].dataType.simpleString()
    blocks = -(-q.count() // block) or 1
    dealt = q.withColumn("block", F.pmod(F.xxhash64("sensor_id"), F.lit(blocks)).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # a pair of blocks: the first's sensors as rows, the second's as columns
    both = dealt.select(F.col("block").alias("i"), F.col("with").alias("j"), F.lit(0).alias("side"), "sensor_id", "city", "m", "s").unionByName(
        dealt.select(F.col("with").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "sensor_id", "city", "m", "s")
    )

    def sums(rows: list[dict], city: pa.DataType) -> pa.RecordBatch:
        a, b = ([r for r in rows if r["side"] == side] for side in (0, 1))
        at, to = (np.array([[r["m"], r["s"]] for r in x]).reshape(-1, 2) for x in (a, b))
        far = np.sqrt(((at[:, None] - to[None]) ** 2).sum(2))
        cities = sorted({r["city"] for r in b}, key=repr)
        of = np.array([[r["city"] == c for c in cities] for r in b], float).reshape(len(b), len(cities))
        there = {r["sensor_id"] for r in b}
        n = of.sum(0)[None, :] - np.array([[r["sensor_id"] in there and r["city"] == c for c in cities] for r in a]).reshape(len(a), len(cities))
        total = far @ of
        out = [(r["sensor_id"], r["city"], c, float(total[x, y]), int(n[x, y])) for x, r in enumerate(a) for y, c in enumerate(cities) if n[x, y]]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.string(), city, city, pa.float64(), pa.int64()), strict=True)], ["sensor_id", "city", "other", "total", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, city = None, [], None
        for batch in batches:
            city = batch.schema.field("city").type
            for row in batch.to_pylist():
                if (row["i"], row["j"]) != held and rows:
                    yield sums(rows, city)
                    rows = []
                held = row["i"], row["j"]
                rows.append(row)
        if rows:
            yield sums(rows, city)

    return both.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, f"sensor_id string, city {kind}, other {kind}, total double, k long")


_WEEKLY = "v AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, sensor_id, CAST(round(CAST(sum(cents) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM r GROUP BY 1, 2)"


@query(f"WITH {READINGS_SQL}, {_WEEKLY}, {drawn_sql('v', 'week,')}, f AS (SELECT week, CAST(sum(c) AS DOUBLE) / count(*) / 100 AS ref FROM v GROUP BY 1) SELECT e.week, n, round(median(100 * abs(est - ref) / ref), 6) AS ape_median FROM e JOIN f ON e.week = f.week GROUP BY 1, 2")
def nested_weekly_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of weekly means as a draw's subset grows sensor by sensor."""
    v = period(readings(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "date"))), "week")
    return simulate(v, ("week",), _median_error, "n int, a double").select("week", "n", six("a").alias("ape_median"))


def farthest_first(s: DataFrame, n: int) -> DataFrame:
    """``(city, place, sensor_id)``: per city, from the sensor nearest the centre on, always that farthest from those chosen.

    Each step is one aggregate over the sensors, which carry their distance to the chosen ones; they and the choice are written
    between steps, so that no step does the work of those before it.
    """
    w = Window.partitionBy("city")
    far = s.withColumn("clat", F.avg("lat").over(w)).withColumn("clon", F.avg("lon").over(w)).withColumn("km", -haversine_km("lat", "lon", "clat", "clon"))
    out = None
    rows = far.select("city", "sensor_id", "lat", "lon", "km")
    for place in range(1, n + 1):
        best = rows.groupBy("city").agg(F.max_by(F.struct("sensor_id", "lat", "lon"), F.struct(F.round("km", 9), -F.col("sensor_id").cast("long"))).alias("p"))
        best = written(best.select("city", F.lit(place).alias("place"), "p.sensor_id", F.col("p.lat").alias("plat"), F.col("p.lon").alias("plon")), "farthest")
        out = best.select("city", "place", "sensor_id") if out is None else out.unionByName(best.select("city", "place", "sensor_id"))
        joined = rows.join(best.select("city", F.col("sensor_id").alias("chosen"), "plat", "plon"), "city").where("sensor_id <> chosen")
        new = haversine_km("lat", "lon", "plat", "plon")
        rows = written(joined.select("city", "sensor_id", "lat", "lon", (new if place == 1 else F.least("km", new)).alias("km")), "distances")
    return out


def _farthest_sql(n: int) -> str:
    km = lambda other: _HAVERSINE.format(a="site", b=other)
    steps = [f"c1 AS (SELECT city, 1 AS place, sensor_id, id, lat, lon FROM (SELECT site.*, row_number() OVER (PARTITION BY site.city ORDER BY round({km('m')}, 9), id) AS k FROM site JOIN m ON m.city = site.city) WHERE k = 1)"]
    for place in range(2, n + 1):
        chosen = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(1, place))
        steps.append(f"""c{place} AS (SELECT city, {place} AS place, sensor_id, id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY round(km, 9) DESC, id) AS k FROM (SELECT site.city, site.sensor_id, site.id, site.lat, site.lon, min({km("ch")}) AS km FROM site JOIN ({chosen}) ch ON ch.city = site.city GROUP BY ALL HAVING bool_and(ch.id <> site.id))) WHERE k = 1)""")
    return f"WITH {SITES_SQL}, m AS (SELECT city, avg(lat) AS lat, avg(lon) AS lon FROM site GROUP BY 1), {', '.join(steps)} " + " UNION ALL ".join(f"SELECT city, CAST(place AS INTEGER) AS place, sensor_id FROM c{k}" for k in range(1, n + 1))


@query(_farthest_sql(DESIGN))
def equidistant_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return farthest_first(sites(readings(spark, sf_dir)), DESIGN)

"""Normality of daily means, permutation tests of their regressions, and designs that spread or bundle sensors.

A city's days are one row with an array where a test needs them together (a row a day, bounded where the test is); permutations
are dealt to tasks by blocks.  Designs grow by a sensor a step, and a step is one aggregate over all sensors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.functions.exprs import EARTH_KM, average_rank, haversine_km, ratio
from stationwise.operators.cells import quadrature_points
from stationwise.operators.panel import six
from stationwise.operators.spatial import hulls, neighbours
from stationwise.plans.registry import READINGS_SQL, query
from stationwise.sources.panel import daily, grid, readings, sites
from stationwise.sources.scratch import written

PERMUTATIONS, PERMUTED, DESIGN, RANGE_KM = 999, 50, 6, 10.0
#: What is added to a place's own variance; degrees between cells of a hull's grid; how many values Shapiro-Wilk's test takes.
JITTER, QUADRATURE_STEP, TESTED = 1e-6, 0.02, (3, 5_000)
_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def by_city(rows: DataFrame, work: Callable[[object, list[dict]], Iterator[tuple]], columns: str) -> DataFrame:
    """The rows that ``work(city, members)`` gives for each row ``(city, members)``; all columns but the city's are in ``columns``."""
    kind = rows.schema["city"].dataType.simpleString()
    names = ["city", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [(row["city"], *r) for r in work(row["city"], row["members"])]
                if found:
                    types = [batch.schema.field("city").type, *(_TYPES[c.split()[1]] for c in columns.split(", "))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return rows.select("city", "members").mapInArrow(run, f"city {kind}, {columns}")


def shapiro_wilk(x: np.ndarray) -> tuple[float, float] | None:
    """W and p by Royston's approximation (1995), for 3 to 5,000 values that are not all equal."""
    x, n = np.sort(np.asarray(x, float)), len(x)
    spread = float(((x - x.mean()) ** 2).sum())
    if not 3 <= n <= 5_000 or not spread > 0:
        return None
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total, u = float(m @ m), n**-0.5
    a = m / math.sqrt(total)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        # Royston's polynomials for the two largest weights
        last = a[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)
        if n > 5:
            before = a[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
            phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = before, -before
        else:
            a = m / math.sqrt((total - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = min(1.0, float(a @ x) ** 2 / spread)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    # Mean and deviation of the transformed statistic
    log_n, off = math.log(n), math.log(max(1 - w, 1e-300))
    if n <= 11:
        z = -math.log(-2.273 + 0.459 * n - off)
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        z = off
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return w, 1 - NormalDist().cdf((z - mean) / sd)


@query()
def daily_normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapiro-Wilk's W and p of each city's daily means, as they are and as logarithms; the scale that looks more normal.

    The test is for 3 to 5,000 values; only cities with so many days come together.
    """
    n = daily(readings(spark, sf_dir)).groupBy("city", "date").agg(F.avg("value").alias("v")).where("v > 0")
    n = n.join(n.groupBy("city").agg(F.count(F.lit(1)).alias("k")).where(F.col("k").between(*TESTED)).select("city"), "city")

    def work(city, members) -> Iterator[tuple]:
        v = np.array([m["v"] for m in members])
        raw, log = shapiro_wilk(v), shapiro_wilk(np.log(v))
        if raw and log:
            yield len(v), *(round(x, 6) for x in (*raw, *log)), "log" if log[0] > raw[0] else "raw"

    return by_city(n.groupBy("city").agg(F.collect_list(F.struct("date", "v")).alias("members")), work, "n long, w double, p double, w_log double, p_log double, scale string")


def _correlations(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each row of ``y`` with each row of ``x``; 0 where either does not vary."""
    y, x = y - y.mean(1, keepdims=True), x - x.mean(1, keepdims=True)
    spread = np.sqrt((y * y).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
    return np.divide(y @ x.T, spread, out=np.zeros_like(spread), where=spread > 1e-12)


def standardised_pair(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The standardised coefficients of each row of ``y`` on the two rows of ``x``."""
    r, between = _correlations(y, x), _correlations(x[:1], x[1:])[0, 0]
    return (r - between * r[:, ::-1]) / (1 - between * between) if abs(between) < 1 - 1e-9 else r


def permutation_counts(rows: DataFrame, permutations: int = PERMUTATIONS, block: int = PERMUTED) -> DataFrame:
    """``(city, n, own, reached, drawn)`` of ``rows(city, key, y, a, b, ry, ra)``: statistics and how many permutations reach each.

    The statistics are the standardised coefficients of y on a and b, and the correlation of the ranks ry and ra.  Blocks of
    permutations are dealt to tasks with a city's rows (a row a day); what they send is counts.  A permutation orders the rows by
    ``md5(permutation|city|key)`` and gives each the y of the row in its place.
    """
    kind = rows.schema["city"].dataType.simpleString()
    held = rows.groupBy("city").agg(F.sort_array(F.collect_list(F.struct("key", "y", "a", "b", "ry", "ra"))).alias("rows")).where(F.size("rows") > 3)
    blocks = F.explode(F.sequence(F.lit(1), F.lit(permutations), F.lit(block)))
    dealt = held.withColumn("first", blocks).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "city", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = [f"|{row['city']}|{r['key']}" for r in row["rows"]]
                y, a, b, ry, ra = (np.array([r[c] for r in row["rows"]], float) for c in ("y", "a", "b", "ry", "ra"))
                order = np.array([sorted(range(len(keys)), key=[hashlib.md5(f"{p}{k}".encode()).digest() for k in keys].__getitem__) for p in range(row["first"], min(permutations + 1, row["first"] + block))])
                from_place = np.argsort(order, axis=1)  # the row in the k-th place gets the k-th row's
                stats = lambda y, ry: np.column_stack([standardised_pair(y, np.stack([a, b])), _correlations(ry, ra[None])])  # noqa: E731, B023
                own, drawn = stats(y[None], ry[None])[0], stats(y[from_place], ry[from_place])
                reached = (np.round(np.abs(drawn), 9) >= np.round(np.abs(own), 9)).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array([row["city"]], batch.schema.field("city").type), pa.array([len(y)]), pa.array([own.tolist()]), pa.array([reached.tolist()], pa.list_(pa.int64())), pa.array([len(drawn)])], ["city", "n", "own", "reached", "drawn"])

    parts = dealt.mapInArrow(run, f"city {kind}, n long, own array<double>, reached array<long>, drawn long")
    return parts.groupBy("city").agg(F.max("n").alias("n"), F.max("own").alias("own"), F.array(*[F.sum(F.get("reached", F.lit(k))) for k in range(3)]).alias("reached"), F.sum("drawn").alias("drawn"))


_RANK = "rank() OVER (PARTITION BY city ORDER BY {0}) + (count(*) OVER (PARTITION BY city, {0}) - 1) / CAST(2 AS DOUBLE)"
_BETA = "(corr({y}, a) - ab * corr({y}, b)) / (1 - ab * ab) AS s1, (corr({y}, b) - ab * corr({y}, a)) / (1 - ab * ab) AS s2"


@query(f"""WITH {READINGS_SQL}, n AS (SELECT city, date, round(ln(1 + avg(value)), 9) AS y, round(1 - count(value) / CAST(count(*) AS DOUBLE), 9) AS a, CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE) AS b FROM grid GROUP BY 1, 2 HAVING count(value) > 0), k AS (SELECT *, {_RANK.format("y")} AS ry, {_RANK.format("a")} AS ra, row_number() OVER (PARTITION BY city ORDER BY date) AS place, count(*) OVER (PARTITION BY city) AS n FROM n),
m AS (SELECT k.city, k.date, k.a, k.b, k.ra, perm, row_number() OVER (PARTITION BY k.city, perm ORDER BY md5(perm || '|' || k.city || '|' || k.date)) AS from_place FROM k CROSS JOIN range(1, {PERMUTATIONS + 1}) AS t(perm) WHERE n > 3), v AS (SELECT m.*, k.y, k.ry FROM m JOIN k ON k.city = m.city AND k.place = m.from_place), c AS (SELECT city, max(n) AS n, corr(a, b) AS ab FROM k GROUP BY 1),
o AS (SELECT k.city, {_BETA.format(y="y")}, corr(ry, ra) AS s3 FROM k JOIN c ON c.city = k.city GROUP BY k.city, ab), p AS (SELECT v.city, perm, {_BETA.format(y="y")}, corr(ry, ra) AS s3 FROM v JOIN c ON c.city = v.city GROUP BY v.city, perm, ab)
SELECT o.city, any_value(c.n) AS n, """ + ", ".join(f"round(any_value(o.{s}), 6) AS {b}, round((1 + count(CASE WHEN round(abs(p.{s}), 9) >= round(abs(o.{s}), 9) THEN 1 END)) / CAST(1 + count(*) AS DOUBLE), 6) AS {q}" for s, b, q in (("s1", "beta_missing", "p_missing"), ("s2", "beta_day", "p_day"), ("s3", "rho", "p_rho"))) + " FROM o JOIN p ON p.city = o.city JOIN c ON c.city = o.city GROUP BY 1")
def regression_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log daily means on missingness and time, by city: coefficients, permutation p-values, and Spearman's rho with its own."""
    d = daily(readings(spark, sf_dir))
    n = grid(d).groupBy("city", "date").agg(F.round(F.log1p(F.avg("value")), 9).alias("y"), F.round(1 - ratio(F.count("value"), F.count(F.lit(1))), 9).alias("a")).where("y IS NOT NULL")
    n = n.select("city", F.col("date").cast("string").alias("key"), "y", "a", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("double").alias("b"))
    c = permutation_counts(n.withColumns({"ry": average_rank("y", "city"), "ra": average_rank("a", "city")}))
    own = lambda k: six(F.get("own", F.lit(k)))
    p = lambda k: six((1 + F.get("reached", F.lit(k))) / (1 + F.col("drawn")))
    return c.select("city", "n", own(0).alias("beta_missing"), p(0).alias("p_missing"), own(1).alias("beta_day"), p(1).alias("p_day"), own(2).alias("rho"), p(2).alias("p_rho"))


def permuted(y: np.ndarray, x: np.ndarray, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For a few rows: standardised coefficients of ``y`` on the columns of ``x``, and two-sided p-values over random permutations."""
    z = lambda a: (a - a.mean(0)) / np.where(a.std(0) > 1e-12, a.std(0), 1.0)
    y, x = z(y), z(x)
    solve = np.linalg.pinv(x)
    own = solve @ y
    rng = np.random.default_rng(seed)
    dealt = np.stack([rng.permutation(y) for _ in range(draws)], 1)
    return own, (1 + (np.abs(solve @ dealt) >= np.abs(own)[:, None] - 1e-12).sum(1)) / (1 + draws)


def distances(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """For a few places: kilometres between all of them."""
    return -np.log(_kernel(lat, lon, lat, lon, 1.0))


def ess(cov: np.ndarray, chosen: list[int]) -> float:
    """The effective sample size of some places: 1' S^-1 1 of their covariances."""
    return float(np.linalg.pinv(cov[np.ix_(chosen, chosen)]).sum())


def greedy(cov: np.ndarray, first: int, size: int, sign: int) -> list[tuple[int, float]]:
    """For a few places with covariances ``cov``, from ``first`` on: the place that raises their effective size most (``sign`` 1) or least (-1), and what it is then."""
    chosen, out = [first], [(first, 1.0)]
    while len(chosen) < min(size, len(cov)):
        inverse = np.linalg.pinv(cov[np.ix_(chosen, chosen)])
        near = cov[chosen]  # the rest's covariances with the chosen
        left = np.maximum(1e-12, 1 - np.einsum("ij,ik,kj->j", near, inverse, near))
        gain = (1 - inverse.sum(0) @ near) ** 2 / left
        gain[chosen] = -np.inf * sign
        best = int(np.argmax(np.round(sign * gain, 9)))
        chosen.append(best)
        out.append((best, ess(cov, chosen)))
    return out


def _kernel(lat: np.ndarray, lon: np.ndarray, other_lat: np.ndarray, other_lon: np.ndarray, length: float) -> np.ndarray:
    """Correlations that fall as ``exp(-km / length)``."""
    a, b, x, y = (np.radians(v) for v in (lat, other_lat, lon, other_lon))
    h = np.sin((b[None, :] - a[:, None]) / 2) ** 2 + np.cos(a)[:, None] * np.cos(b)[None, :] * np.sin((y[None, :] - x[:, None]) / 2) ** 2
    return np.exp(-2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h))) / length)


def information(lat: list[float], lon: list[float], c: list[float], length: float = RANGE_KM) -> float:
    """``c' S^-1 c`` of some places' correlations S; with ones for ``c`` their effective sample size."""
    s = _kernel(*(np.array(v) for v in (lat, lon, lat, lon)), length) + JITTER * np.eye(len(lat))
    return float(np.array(c) @ np.linalg.pinv(s) @ np.array(c))


def gains(sensors: DataFrame, state: DataFrame, length: float = RANGE_KM) -> DataFrame:
    """``(city, design, sensor_id, lat, lon, c, gain)``: what each sensor not yet chosen would add to the information of those chosen.

    ``sensors(city, sensor_id, lat, lon, c_...)`` are dealt as they come; ``state(city, design, sign, chosen)`` has a few rows.
    """
    kind = sensors.schema["city"].dataType.simpleString()
    rows = sensors.join(state, "city").select("city", "design", "sign", "sensor_id", "lat", "lon", F.when(F.col("design") == "min_pred_var", F.col("c")).otherwise(1.0).alias("c"), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            city, design = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lat, lon, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 6))
            ids, gain = batch.column(3).to_pylist(), np.full(len(city), -np.inf)
            groups: dict[tuple, list[int]] = {}
            for k, g in enumerate(zip(city, design, strict=True)):
                groups.setdefault(g, []).append(k)
            for own in groups.values():
                chosen = batch.column(7)[own[0]].as_py()
                s_lat, s_lon, s_c = (np.array([x[n] for x in chosen], float) for n in ("lat", "lon", "c"))
                inverse = np.linalg.pinv(_kernel(s_lat, s_lon, s_lat, s_lon, length) + JITTER * np.eye(len(chosen)))
                near = _kernel(s_lat, s_lon, lat[own], lon[own], length)
                left = np.maximum(1e-12, 1 + JITTER - np.einsum("ij,ik,kj->j", near, inverse, near))
                found = (c[own] - s_c @ inverse @ near) ** 2 / left
                taken = {x["sensor_id"] for x in chosen}
                gain[own] = np.where([ids[k] in taken for k in own], np.nan, found)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(7)), pa.array(gain, mask=np.isnan(gain))], [*batch.schema.names[:7], "gain"])

    return rows.mapInArrow(run, f"city {kind}, design string, sign int, sensor_id string, lat double, lon double, c double, gain double").where("gain IS NOT NULL")


def quadrature_means(s: DataFrame, length: float = RANGE_KM, step: float = QUADRATURE_STEP) -> DataFrame:
    """``s`` with ``c``: each sensor's mean correlation with the points of a grid within its city's hull, or 1 where that holds none."""
    corners = hulls(s, "city", "lon", "lat")
    ring = Window.partitionBy("city").orderBy("seq")
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(ring))
    edges = corners.select(F.col("city").alias("poly"), F.col("x").alias("x1"), F.col("y").alias("y1"), after("x").alias("x2"), after("y").alias("y2"))
    q = quadrature_points(edges, step, 2).select(F.col("poly").alias("city"), F.struct(F.col("y").alias("lat"), F.col("x").alias("lon")).alias("p")).groupBy("city").agg(F.collect_list("p").alias("points"))  # a grid of that step
    km = lambda p: haversine_km("lat", "lon", p["lat"], p["lon"])
    total = F.aggregate("points", F.lit(0.0), lambda acc, p: acc + F.exp(-km(p) / length))
    return s.join(q, "city", "left").withColumn("c", F.coalesce(total / F.size("points"), F.lit(1.0))).drop("points")


def designs(s: DataFrame, size: int = DESIGN, length: float = RANGE_KM) -> DataFrame:
    """``(city, design, place, sensor_id, ess, information)`` of sensors chosen one at a time, each step one aggregate over ``s(city, sensor_id, lat, lon)``.

    ``max_ess`` starts from the two hull corners that lie farthest apart, ``min_ess`` from the two sensors that lie closest, and each
    takes what adds most, or least, to the effective sample size.  ``min_pred_var`` starts from the sensor that stands best for the
    city's hull, and takes what tells most of it.
    """
    s = written(quadrature_means(s.select("city", "sensor_id", "lat", "lon"), length), "design-sensors")
    one = lambda c: F.struct(F.col(f"{c}.sensor_id"), F.col(f"{c}.lat"), F.col(f"{c}.lon"), F.lit(1.0).alias("c"))
    place = F.struct("sensor_id", "lat", "lon")
    number = lambda c: F.col(f"{c}.sensor_id").cast("long")
    corners = hulls(s, "city", "lon", "lat").select(F.col("city"), F.col("x").alias("lon"), F.col("y").alias("lat"))
    first = s.join(corners, ["city", "lat", "lon"]).groupBy("city", "lat", "lon").agg(F.min_by(place, F.col("sensor_id").cast("long")).alias("p")).select("city", "p")
    far = first.join(first.withColumnRenamed("p", "q"), "city").where(number("p") < number("q"))  # a hull's corners
    far = far.groupBy("city").agg(F.max_by(F.struct("p", "q"), F.struct(F.round(haversine_km("p.lat", "p.lon", "q.lat", "q.lon"), 9), -number("p"), -number("q"))).alias("b"))
    near = neighbours(s, 1).where(F.col("a").cast("long") < F.col("b").cast("long"))
    near = near.groupBy("city").agg(F.min_by(F.struct("a", "b"), F.struct(F.round("km", 9), F.col("a").cast("long"), F.col("b").cast("long"))).alias("n"))
    of = lambda n: s.select("city", F.col("sensor_id").alias(n), place.alias(f"p_{n}"))
    near = near.select("city", "n.*").join(of("a"), ["city", "a"]).join(of("b"), ["city", "b"]).select("city", F.struct(F.col("p_a").alias("p"), F.col("p_b").alias("q")).alias("b"))
    state = far.select("city", F.lit("max_ess").alias("design"), F.lit(1).alias("sign"), F.array(one("b.p"), one("b.q")).alias("chosen")).union(near.select("city", F.lit("min_ess"), F.lit(-1), F.array(one("b.p"), one("b.q"))))
    best = s.groupBy("city").agg(F.max_by(F.struct("sensor_id", "lat", "lon", "c"), F.struct(F.round("c", 9), -F.col("sensor_id").cast("long"))).alias("p"))
    state = written(state.union(best.select("city", F.lit("min_pred_var"), F.lit(1), F.array("p"))), "design-state")
    for _ in range(size - 1):
        g = gains(s, state.where(F.size("chosen") < size), length)
        new = g.groupBy("city", "design").agg(F.max_by(F.struct("sensor_id", "lat", "lon", "c"), F.struct(F.round(F.col("sign") * F.col("gain"), 9), -F.col("sensor_id").cast("long"))).alias("new"))
        state = written(state.join(new, ["city", "design"], "left").select("city", "design", "sign", F.when(F.col("new").isNull(), F.col("chosen")).otherwise(F.concat("chosen", F.array("new"))).alias("chosen")), "design-state")

    def scores(rows: list[dict]) -> Iterator[tuple]:
        for r in rows:
            lat, lon, c = ([x[n] for x in r["chosen"]] for n in ("lat", "lon", "c"))
            for k, x in enumerate(r["chosen"], 1):
                yield r["city"], r["design"], k, x["sensor_id"], round(information(lat[:k], lon[:k], [1.0] * k, length), 6), round(information(lat[:k], lon[:k], c[:k], length), 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = (batch.schema.field("city").type, pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64())
            if found := list(scores(batch.to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["city", "design", "place", "sensor_id", "ess", "information"])

    kind = s.schema["city"].dataType.simpleString()
    return state.mapInArrow(run, f"city {kind}, design string, place int, sensor_id string, ess double, information double")


@query()
def effective_size_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs of six sensors of each city: the largest and least effective sample size, and the least predictive variance."""
    return designs(sites(readings(spark, sf_dir)))

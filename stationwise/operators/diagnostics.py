"""Summaries, tests and checks over daily means: representative days, quantile pairs, error days, significance, manifests."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.functions.exprs import correlation, percent, ratio
from stationwise.operators.gaps import retained, scenario_sql
from stationwise.operators.panel import share, six
from stationwise.operators.sampling import DAILY, _median_error, _percentiles, day_values, drawn_sql, simulate
from stationwise.operators.spatial import BAND_KM, LINKS, moran_sums, variogram_bins
from stationwise.plans.registry import ORACLES, READINGS_SQL, query
from stationwise.sources.panel import daily, grid, mean, readings, sites

W = f"WITH {READINGS_SQL} "
LEAST_SENSORS, SPACED, UTC_MINUTES = 10, 12, 330
_NETWORK = W + ", n AS (SELECT city, date, avg(value) AS v, count(*) AS k FROM d GROUP BY 1, 2)"


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(city, date, v, k)``: daily network means and how many sensors gave them."""
    return daily(readings(spark, sf_dir)).groupBy("city", "date").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("k"))


def erfc(x: Column) -> Column:
    """The complementary error function of numbers from 0 on."""
    # Abramowitz and Stegun 7.1.26
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def _erfc_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911::DOUBLE * ({x})))"
    return f"({t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-({x}) * ({x})))"


def z_score(p: Column) -> Column:
    """The normal quantile of probabilities."""
    # Abramowitz and Stegun 26.2.23
    t = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -z).otherwise(z)


@query(_NETWORK + " SELECT city, count(*) AS n_days, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(stddev_samp(v) / avg(v), 6) AS cv FROM n GROUP BY city")
def concentration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.percentile("v", F.lit(p))
    return network(spark, sf_dir).groupBy("city").agg(F.count(F.lit(1)).alias("n_days"), six(F.avg("v")).alias("mean"), six(q(0.5)).alias("median"), six(q(0.1)).alias("p10"), six(q(0.9)).alias("p90"), six(q(0.75) - q(0.25)).alias("iqr"), six(ratio(F.stddev_samp("v"), F.avg("v"))).alias("cv"))


@query(_NETWORK + " SELECT city, max(k) AS most_sensors, min(k) AS least_sensors FROM n GROUP BY city")
def sensors_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).groupBy("city").agg(F.max("k").alias("most_sensors"), F.min("k").alias("least_sensors"))


@query(_NETWORK + f""", m AS (SELECT *, median(v) OVER (PARTITION BY city) AS mid, greatest({LEAST_SENSORS}, median(k) OVER (PARTITION BY city)) AS least FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY round(abs(v - mid), 9), date) AS place FROM m WHERE k >= least)
SELECT city, date, k AS n_sensors, round(v, 6) AS mean FROM o WHERE place = 1""")
def representative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of each city whose mean is nearest the median day's, among days with enough sensors."""
    n = network(spark, sf_dir)
    mid = n.groupBy("city").agg(F.percentile("v", F.lit(0.5)).alias("mid"), F.greatest(F.lit(float(LEAST_SENSORS)), F.percentile("k", F.lit(0.5))).alias("least"))
    near = n.join(mid, "city").where("k >= least").groupBy("city")
    return near.agg(F.min_by(F.struct("date", "k", "v"), F.struct(F.round(F.abs(F.col("v") - F.col("mid")), 9), "date")).alias("p")).select("city", "p.date", F.col("p.k").alias("n_sensors"), six("p.v").alias("mean"))


@query(_NETWORK + f""", o AS (SELECT city, date, k, row_number() OVER (PARTITION BY city ORDER BY date) - 1 AS place, count(*) OVER (PARTITION BY city) AS days FROM n WHERE k >= 3), p AS (SELECT DISTINCT city, i * (days - 1) // {SPACED - 1} AS place FROM o CROSS JOIN range({SPACED}) AS t(i)) SELECT o.city, o.date, k AS n_sensors FROM o JOIN p ON p.city = o.city AND p.place = o.place""")
def spaced_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most twelve evenly spaced days of each city, among those with three sensors."""
    n = network(spark, sf_dir).where("k >= 3")
    w = Window.partitionBy("city")
    o = n.withColumn("place", F.row_number().over(w.orderBy("date")) - 1).withColumn("days", F.count(F.lit(1)).over(w))
    wanted = F.exists(F.sequence(F.lit(0), F.lit(SPACED - 1)), lambda i: F.floor(i * (F.col("days") - 1) / (SPACED - 1)) == F.col("place"))
    return o.where(wanted).select("city", "date", F.col("k").alias("n_sensors"))


@query(W + f"SELECT sensor_id, CAST(ts + INTERVAL {UTC_MINUTES} MINUTE AS DATE) AS local_date, count(*) AS n, round(CAST(sum(cents) AS DOUBLE) / count(*) / 100, 6) AS value FROM r GROUP BY 1, 2")
def local_daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the days of the sensors' own time zone, whose readings are stamped in UTC."""
    r = readings(spark, sf_dir).withColumn("local_date", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Kolkata")))
    return r.groupBy("sensor_id", "local_date").agg(F.count(F.lit(1)).alias("n"), six(mean()).alias("value"))


@query(_NETWORK + """, o AS (SELECT city, v, row_number() OVER (PARTITION BY city ORDER BY v, date) AS place, count(*) OVER (PARTITION BY city) AS days FROM n), p AS (SELECT *, (place - 0.5::DOUBLE) / days AS p FROM o), t AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM p),
z AS (SELECT *, (t - (2.515517::DOUBLE + 0.802853::DOUBLE * t + 0.010328::DOUBLE * t * t) / (1 + 1.432788::DOUBLE * t + 0.189269::DOUBLE * t * t + 0.001308::DOUBLE * t * t * t)) * CASE WHEN p < 0.5 THEN -1 ELSE 1 END AS z FROM t) SELECT city, place, round(z, 6) AS z, round(v, 6) AS value FROM z""")
def normal_quantile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each daily mean beside the normal quantile of its rank in its city."""
    w = Window.partitionBy("city")
    o = network(spark, sf_dir).withColumn("place", F.row_number().over(w.orderBy("v", "date"))).withColumn("days", F.count(F.lit(1)).over(w))
    return o.select("city", "place", six(z_score((F.col("place") - 0.5) / F.col("days"))).alias("z"), six("v").alias("value"))


@query(DAILY + ", m AS (SELECT e.date, round(median(100 * abs(est - ref) / ref), 6) AS error FROM e JOIN f ON e.date = f.date WHERE n = 10 GROUP BY 1), z AS (SELECT *, quantile_cont(error, 0.95) OVER () AS line FROM m) SELECT date, error, round(line, 6) AS line FROM z WHERE error >= line")
def high_error_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose median error with ten sensors reaches the 95th percentile of all days."""
    m = simulate(day_values(readings(spark, sf_dir)), ("date",), _percentiles((10,), 50), "n int, n_draws long, error double").select("date", six("error").alias("error"))
    line = m.agg(F.percentile("error", F.lit(0.95)).alias("line"))
    return m.crossJoin(F.broadcast(line)).where("error >= line").select("date", "error", six("line").alias("line"))


_MISSING = ", n AS (SELECT city, date, avg(value) AS v, 1 - count(value) / CAST(count(*) AS DOUBLE) AS miss FROM grid GROUP BY 1, 2 HAVING count(value) > 0)"


@query(W + _MISSING + f""", c AS (SELECT city, count(*) AS n, corr(v, miss) AS r FROM n GROUP BY 1 HAVING count(*) > 3), z AS (SELECT *, 0.5::DOUBLE * ln((1 + r) / (1 - r)) * sqrt(n - 3) AS z FROM c WHERE abs(r) < 1) SELECT city, n, round(r, 6) AS r, round(z, 5) AS z, round({_erfc_sql("abs(z) / sqrt(2)")}, 5) AS p FROM z""")
def missingness_correlation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a day's mean go with its share of missing sensors?  Fisher's z and its two-sided p."""
    n = grid(daily(readings(spark, sf_dir))).groupBy("city", "date").agg(F.avg("value").alias("v"), (1 - ratio(F.count("value"), F.count(F.lit(1)))).alias("miss"), F.count("value").alias("seen")).where("seen > 0")
    c = n.groupBy("city").agg(F.count(F.lit(1)).alias("n"), correlation("v", "miss").alias("r")).where("n > 3 AND abs(r) < 1")
    z = F.atanh("r") * F.sqrt(F.col("n") - 3)
    return c.select("city", "n", six("r").alias("r"), F.round(z, 5).alias("z"), F.round(erfc(F.abs(z) / F.sqrt(F.lit(2.0))), 5).alias("p"))


@query(W + _MISSING + """, x AS (SELECT city, ln(1 + v) AS y, miss AS a, CAST(date_diff('day', (SELECT lo FROM b), date) AS DOUBLE) AS t FROM n), c AS (SELECT city, count(*) AS n, corr(y, a) AS ya, corr(y, t) AS yt, corr(a, t) AS ax FROM x GROUP BY 1), e AS (SELECT *, (ya - yt * ax) / (1 - ax * ax) AS ba, (yt - ya * ax) / (1 - ax * ax) AS bt FROM c WHERE n > 3 AND abs(ax) < 0.999999)
SELECT city, n, round(ba, 5) AS beta_missing, round(bt, 5) AS beta_day, round(ba * ya + bt * yt, 5) AS r2 FROM e""")
def standardised_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised coefficients of log daily means on missingness and time, by least squares, and R squared."""
    d = daily(readings(spark, sf_dir))
    lo = d.agg(F.min("date").alias("lo"))
    n = grid(d).groupBy("city", "date").agg(F.avg("value").alias("v"), (1 - ratio(F.count("value"), F.count(F.lit(1)))).alias("a"), F.count("value").alias("seen")).where("seen > 0").crossJoin(F.broadcast(lo))
    x = n.select("city", F.log1p("v").alias("y"), "a", F.datediff("date", "lo").cast("double").alias("t"))
    c = x.groupBy("city").agg(F.count(F.lit(1)).alias("n"), correlation("y", "a").alias("ya"), correlation("y", "t").alias("yt"), correlation("a", "t").alias("at")).where("n > 3 AND abs(at) < 0.999999")
    ya, yt, at = (F.col(k) for k in ("ya", "yt", "at"))
    ba, bt = (ya - yt * at) / (1 - at * at), (yt - ya * at) / (1 - at * at)
    return c.select("city", "n", F.round(ba, 5).alias("beta_missing"), F.round(bt, 5).alias("beta_day"), F.round(ba * ya + bt * yt, 5).alias("r2"))


@query(f"""WITH {READINGS_SQL}, {LINKS}, z AS (SELECT city, date, sensor_id, value - avg(value) OVER (PARTITION BY city, date) AS z FROM d), m AS (SELECT city, date, CAST(count(*) AS DOUBLE) AS n, sum(z * z) AS s2, sum(z * z * z * z) AS s4 FROM z GROUP BY 1, 2),
g AS (SELECT zi.city, zi.date, zi.sensor_id, CAST(count(*) AS DOUBLE) AS k, sum(zi.z * zj.z) AS num FROM e JOIN z zi ON zi.sensor_id = e.a JOIN z zj ON zj.sensor_id = e.b AND zj.date = zi.date GROUP BY 1, 2, 3), l AS (SELECT city, date, sum(k) AS s0, 4 * sum(k * k) AS w2, sum(num) AS num FROM g GROUP BY 1, 2),
x AS (SELECT m.city, m.date, n, s0, 2 * s0 AS w1, w2, n / s0 * num / s2 AS i, n * s4 / (s2 * s2) AS b2 FROM m JOIN l ON l.city = m.city AND l.date = m.date WHERE n >= 5 AND s2 > 0), y AS (SELECT *, -1 / (n - 1) AS ex, (n * ((n * n - 3 * n + 3) * w1 - n * w2 + 3 * s0 * s0) - b2 * ((n * n - n) * w1 - 2 * n * w2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - 1 / ((n - 1) * (n - 1)) AS var FROM x),
q AS (SELECT *, (i - ex) / sqrt(var) AS z FROM y WHERE var > 1e-12) SELECT city, date, CAST(n AS BIGINT) AS n, round(i, 5) AS moran, round(var, 6) AS variance, round(z, 4) AS z, round(CASE WHEN z >= 0 THEN 0.5 * {_erfc_sql("abs(z) / sqrt(2)")} ELSE 1 - 0.5 * {_erfc_sql("abs(z) / sqrt(2)")} END, 4) AS p_upper FROM q""")
def moran_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moran's I of each day with its variance under randomisation, z and upper p, for days with five sensors."""
    r = readings(spark, sf_dir)
    x = moran_sums(daily(r), sites(r), BAND_KM).withColumns({"n": F.col("n").cast("double"), "s0": F.col("s0").cast("double"), "w2": 4 * F.col("k2")}).where("n >= 5 AND s2 > 0")
    n, s0, w1, w2, b2 = F.col("n"), F.col("s0"), 2 * F.col("s0"), F.col("w2"), F.col("n") * F.col("s4") / (F.col("s2") * F.col("s2"))
    var = (n * ((n * n - 3 * n + 3) * w1 - n * w2 + 3 * s0 * s0) - b2 * ((n * n - n) * w1 - 2 * n * w2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - 1 / ((n - 1) * (n - 1))
    x = x.withColumn("i", n / s0 * F.col("num") / F.col("s2")).withColumn("var", var).where("var > 1e-12").withColumn("score", (F.col("i") + 1 / (n - 1)) / F.sqrt("var"))
    tail = 0.5 * erfc(F.abs("score") / F.sqrt(F.lit(2.0)))
    return x.select("city", "date", n.cast("long").alias("n"), F.round("i", 5).alias("moran"), F.round("var", 6).alias("variance"), F.round("score", 4).alias("z"), F.round(F.when(F.col("score") >= 0, tail).otherwise(1 - tail), 4).alias("p_upper"))


DECAY = (0.9, 0.7, 0.5, 0.3, 0.1, 0.0)


@query(f"WITH v AS ({ORACLES['variogram_bins']}), c AS (SELECT DISTINCT city FROM v), t(level) AS (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in DECAY)}) SELECT c.city, t.level, min(v.from_km) AS from_km FROM c CROSS JOIN t LEFT JOIN v ON v.city = c.city AND v.median_r <= t.level GROUP BY 1, 2")
def decay_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first distance bin of each city whose median correlation is at a level or below; null where none is."""
    v = variogram_bins(spark, sf_dir).select("city", "from_km", "median_r")
    t = v.withColumn("level", F.explode(F.array(*map(F.lit, DECAY))))
    return t.groupBy("city", "level").agg(F.min(F.when(F.col("median_r") <= F.col("level"), F.col("from_km"))).alias("from_km"))


@query(f"""WITH v AS ({scenario_sql()} SELECT scenario, sensor_id, CAST(round(100 * avg(v)) AS BIGINT) AS c FROM kept WHERE v IS NOT NULL GROUP BY 1, 2), {drawn_sql("v", "scenario,")}, f AS (SELECT scenario, CAST(sum(c) AS DOUBLE) / count(*) / 100 AS ref, count(*) AS k FROM v GROUP BY 1),
m AS (SELECT e.scenario, n, any_value(f.k) AS k, median(100 * abs(est - ref) / ref) AS a FROM e JOIN f ON f.scenario = e.scenario GROUP BY 1, 2) SELECT scenario, max(k) AS n_sensors, CAST(min(CASE WHEN a <= 5 THEN n END) AS INTEGER) AS n_required, round(min(CASE WHEN n = 10 THEN a END), 6) AS mdape_10 FROM m GROUP BY scenario""")
def scenario_required_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sensors each completeness scenario needs for a median error of its period mean of 5 %."""
    v = retained(grid(daily(readings(spark, sf_dir)))).where("value IS NOT NULL").groupBy("scenario", "sensor_id").agg(F.round(100 * F.avg("value")).cast("long").alias("c"))
    m = simulate(v, ("scenario",), _median_error, "n int, a double")
    sizes = v.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_sensors"))
    need = m.groupBy("scenario").agg(F.min(F.when(F.col("a") <= 5, F.col("n"))).alias("n_required"), six(F.min(F.when(F.col("n") == 10, F.col("a")))).alias("mdape_10"))
    return sizes.join(need, "scenario")


@query(W + ", p AS (SELECT sensor_id, count(*) AS n FROM r GROUP BY 1), q AS (SELECT sensor_id FROM d WHERE hours >= 2 GROUP BY 1) SELECT count(*) AS n_left, count(q.sensor_id) AS n_joined, count(*) - count(q.sensor_id) AS n_missing, CASE WHEN count(*) = count(q.sensor_id) THEN 'pass' ELSE 'fail' END AS status FROM p LEFT JOIN q ON q.sensor_id = p.sensor_id")
def join_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is there a day of two valid hours for every sensor that has readings?  Counted by an anti-join."""
    r = readings(spark, sf_dir)
    p, q = r.select("sensor_id").distinct(), daily(r).where("hours >= 2").select("sensor_id").distinct()
    n, missing = p.agg(F.count(F.lit(1)).alias("n_left")), p.join(q, "sensor_id", "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    out = n.crossJoin(missing)  # one row each
    return out.select("n_left", (F.col("n_left") - F.col("n_missing")).alias("n_joined"), "n_missing", F.when(F.col("n_missing") == 0, "pass").otherwise("fail").alias("status"))


@query(W + """, c AS (SELECT (SELECT count(*) FROM grid) AS cells, (SELECT count(*) FROM s) * (SELECT count(*) FROM days) AS expected, (SELECT count(value) FROM grid) AS seen, (SELECT count(*) FROM d) AS daily) SELECT 'grid cells' AS name, expected, cells AS observed, CASE WHEN expected = cells THEN 'pass' ELSE 'fail' END AS status FROM c
UNION ALL SELECT 'daily values', daily, seen, CASE WHEN daily = seen THEN 'pass' ELSE 'fail' END FROM c UNION ALL SELECT 'filled cells', cells, seen, CASE WHEN cells = seen THEN 'pass' WHEN seen > 0 THEN 'warn' ELSE 'fail' END FROM c""")
def panel_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the panel should hold, and what it does."""
    d = daily(readings(spark, sf_dir))
    cells = grid(d).agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("seen"))
    size = d.agg(F.count(F.lit(1)).alias("daily"), F.count_distinct("sensor_id").alias("sensors"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("days"))
    c = cells.crossJoin(size).withColumn("expected", F.col("sensors") * F.col("days"))  # one row each
    row = lambda name, want, got: F.struct(F.lit(name).alias("name"), F.col(want).cast("long").alias("expected"), F.col(got).alias("observed"), F.when(F.col(want) == F.col(got), "pass").when(F.lit(name == "filled cells") & (F.col(got) > 0), "warn").otherwise("fail").alias("status"))
    return c.select(F.inline(F.array(row("grid cells", "expected", "cells"), row("daily values", "daily", "seen"), row("filled cells", "cells", "seen"))))


@query(W + "SELECT city, count(*) AS n_days, round(100 * avg(CASE WHEN value IS NOT NULL THEN 1::DOUBLE ELSE 0 END), 6) AS valid_pct, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM grid WHERE date BETWEEN (SELECT lo + 7 FROM b) AND (SELECT lo + 20 FROM b) GROUP BY city")
def date_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the fortnight that begins a week after the first day."""
    g = grid(daily(readings(spark, sf_dir)))
    lo = g.agg(F.min("date").alias("lo"))  # one row
    inside = g.crossJoin(F.broadcast(lo)).where(F.col("date").between(F.date_add("lo", 7), F.date_add("lo", 20)))
    return inside.groupBy("city").agg(F.count(F.lit(1)).alias("n_days"), six(100 * share(F.col("value").isNotNull())).alias("valid_pct"), six(F.avg("value")).alias("mean"), six(F.min("value")).alias("least"), six(F.max("value")).alias("most"))


@query(W + "SELECT city, count(*) AS cells, count(value) AS finite, round(100 * count(value) / CAST(count(*) AS DOUBLE), 6) AS finite_pct FROM grid GROUP BY city")
def finite_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's cells that hold a finite number."""
    v = F.col("value")
    ok = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return grid(daily(readings(spark, sf_dir))).groupBy("city").agg(F.count(F.lit(1)).alias("cells"), F.count(ok).alias("finite"), six(percent(F.count(ok), F.count(F.lit(1)))).alias("finite_pct"))


@query()
def sensor_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of variance that each principal component of the sensors' standardised profiles explains."""
    g = grid(daily(readings(spark, sf_dir))).groupBy("sensor_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), share(F.col("value").isNotNull()).alias("uptime")).where("sd IS NOT NULL")
    names = ["mean", "sd", "uptime"]
    stats = g.agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = g.crossJoin(F.broadcast(stats)).select("sensor_id", *[F.coalesce(ratio(F.col(c) - F.col(f"{c}_m"), f"{c}_s"), F.lit(0.0)).alias(c) for c in names])
    z = VectorAssembler(inputCols=names, outputCol="features").transform(z)
    model = PCA(k=len(names), inputCol="features", outputCol="scores").fit(z)
    explained = [float(x) for x in model.explainedVariance]
    spread = model.transform(z).select(F.posexplode(vector_to_array("scores"))).groupBy((F.col("pos") + 1).alias("component")).agg(six(F.var_samp("col")).alias("variance"))
    return spread.withColumn("explained", six(F.element_at(F.array(*map(F.lit, explained)), F.col("component"))))

"""Distribution tests, required sample sizes, intervals under autocorrelation, regressions and clusters."""

from __future__ import annotations



from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.functions.exprs import correlation, ratio, season
from stationwise.operators.panel import LINES, official, share, six
from stationwise.operators.sampling import DRAWS, SEED
from stationwise.plans.registry import READINGS_SQL, query
from stationwise.sources.panel import daily, grid, load, readings

W = f"WITH {READINGS_SQL} "
KS_RANGES = 128


@query(LINES + """, x AS (SELECT value, CASE WHEN month(date) IN (12, 1, 2) THEN 1 ELSE 0 END AS w FROM d), v AS (SELECT value, sum(w) AS a, count(*) - sum(w) AS b FROM x GROUP BY value), n AS (SELECT CAST(sum(w) AS DOUBLE) AS na, CAST(count(*) - sum(w) AS DOUBLE) AS nb FROM x),
c AS (SELECT sum(a) OVER (ORDER BY value) / na AS fa, sum(b) OVER (ORDER BY value) / nb AS fb, na, nb FROM v CROSS JOIN n) SELECT CAST(max(na) AS BIGINT) AS n_winter, CAST(max(nb) AS BIGINT) AS n_other, round(max(abs(fa - fb)), 6) AS ks, round(least(1, 2 * exp(-2 * max(na) * max(nb) / (max(na) + max(nb)) * pow(max(abs(fa - fb)), 2))), 6) AS p FROM c""")
def ks_winter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of winter against the other days.

    Running counts come from a range partitioning of the values, at sampled quantiles so that a heavy tail fills no range:
    within each range, after the counts of the ranges before.
    """
    x = official(spark, sf_dir).select("value", (season(F.month("date")) == "DJF").cast("long").alias("w"))
    v = x.groupBy("value").agg(F.sum("w").alias("a"), F.sum(1 - F.col("w")).alias("b"))
    cuts = v.agg(F.percentile_approx("value", F.array(*[F.lit(k / KS_RANGES) for k in range(1, KS_RANGES)]), F.lit(100 * KS_RANGES)).alias("cuts"))
    v = v.crossJoin(F.broadcast(cuts)).withColumn("cell", F.size(F.filter("cuts", lambda c: c <= F.col("value")))).drop("cuts")
    totals = v.groupBy("cell").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most KS_RANGES rows
    totals = totals.select("cell", F.coalesce(F.sum("ta").over(before), F.lit(0)).alias("pa"), F.coalesce(F.sum("tb").over(before), F.lit(0)).alias("pb"))
    n = x.agg(F.sum("w").cast("double").alias("na"), F.sum(1 - F.col("w")).cast("double").alias("nb"))
    inside = Window.partitionBy("cell").orderBy("value")
    c = v.join(F.broadcast(totals), "cell").crossJoin(F.broadcast(n))
    gap = F.abs((F.col("pa") + F.sum("a").over(inside)) / F.col("na") - (F.col("pb") + F.sum("b").over(inside)) / F.col("nb"))
    c = c.select("na", "nb", gap.alias("gap")).groupBy("na", "nb").agg(F.max("gap").alias("ks"))
    n_eff = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    return c.select(F.col("na").cast("long").alias("n_winter"), F.col("nb").cast("long").alias("n_other"), six("ks").alias("ks"), six(F.least(F.lit(1.0), 2 * F.exp(-2 * n_eff * F.col("ks") * F.col("ks")))).alias("p"))


@query(W + """, x AS (SELECT city, date % 7 AS part, value FROM (SELECT city, date_diff('day', DATE '2024-01-01', date) AS date, value FROM grid)), g AS (SELECT city, part, count(*) AS n, count(*) - count(value) AS miss FROM x GROUP BY 1, 2), t AS (SELECT city, sum(miss) / CAST(sum(n) AS DOUBLE) AS p FROM g GROUP BY 1)
SELECT g.city, count(*) AS groups, round(sum(pow(miss - n * p, 2) / (n * p) + pow(miss - n * p, 2) / (n * (1 - p))), 6) AS chi2 FROM g JOIN t ON g.city = t.city WHERE p > 0 AND p < 1 GROUP BY g.city""")
def chi2_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether days are missing alike on all days of the week."""
    x = grid(daily(readings(spark, sf_dir))).withColumn("part", F.pmod(F.datediff("date", F.lit("2024-01-01")), F.lit(7)))
    g = x.groupBy("city", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("miss"))
    p = F.sum("miss").over(Window.partitionBy("city")) / F.sum("n").over(Window.partitionBy("city"))
    g = g.withColumn("p", p).where("p > 0 AND p < 1")
    off = F.pow(F.col("miss") - F.col("n") * F.col("p"), F.lit(2))
    return g.groupBy("city").agg(F.count(F.lit(1)).alias("groups"), six(F.sum(off / (F.col("n") * F.col("p")) + off / (F.col("n") * (1 - F.col("p"))))).alias("chi2"))


_MOMENTS = "count(*) AS n, avg(value) AS m, stddev_samp(value) AS s, avg(pow(value, 3)) AS m3, avg(pow(value, 2)) AS m2, avg(pow(value, 4)) AS m4"


@query(W + f""", a AS (SELECT date, {_MOMENTS} FROM d GROUP BY date), k AS (SELECT date, n, (m3 - 3 * m * m2 + 2 * pow(m, 3)) / pow(s, 3) AS skew, (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * pow(m, 4)) / pow(s, 4) - 3 AS kurt FROM a WHERE n >= 8 AND s > 0)
SELECT date, n, round(skew, 5) AS skew, round(kurt, 5) AS kurt, round(n / CAST(6 AS DOUBLE) * (skew * skew + kurt * kurt / 4), 4) AS jb, round(exp(-n / CAST(12 AS DOUBLE) * (skew * skew + kurt * kurt / 4)), 4) AS p FROM k""")
def daily_jarque_bera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewness and excess kurtosis of values standardised by the sample deviation, and the Jarque-Bera test."""
    v = F.col("value")
    a = daily(readings(spark, sf_dir)).groupBy("date").agg(F.count(v).alias("n"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"), F.stddev_samp(v).alias("s")).where("n >= 8 AND s > 0")
    small = (F.col("n") - 1) / F.col("n")
    a = a.withColumn("skew", F.col("g1") * F.pow(small, F.lit(1.5))).withColumn("kurt", (F.col("g2") + 3) * small * small - 3)
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return a.select("date", "n", F.round("skew", 5).alias("skew"), F.round("kurt", 5).alias("kurt"), F.round(jb, 4).alias("jb"), F.round(F.exp(-jb / 2), 4).alias("p"))


@query(W + """, m AS (SELECT date, avg(value) AS m, stddev_samp(value) AS s, median(value) AS med, stddev_samp(ln(value)) AS e FROM d WHERE value > 0 GROUP BY date)
SELECT date, CAST(ceil(round(pow(s / (0.1 * m), 2), 9)) AS BIGINT) AS n_normal, CAST(ceil(round((exp(e * e) - 1) / 0.01, 9)) AS BIGINT) AS n_lognormal FROM m""")
def required_sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors for a relative standard error of 10 %, if daily values are normal or lognormal."""
    m = daily(readings(spark, sf_dir)).where("value > 0").groupBy("date").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.stddev_samp(F.ln("value")).alias("e"))
    up = lambda c: F.ceil(F.round(c, 9)).cast("long")
    return m.select("date", up(F.pow(F.col("s") / (0.1 * F.col("m")), F.lit(2))).alias("n_normal"), up((F.exp(F.col("e") * F.col("e")) - 1) / 0.01).alias("n_lognormal"))


@query(W + """, m AS (SELECT date, CAST(ceil(round(pow(stddev_samp(value) / (0.1 * avg(value)), 2), 9)) AS BIGINT) AS need FROM d WHERE value > 0 GROUP BY date)
SELECT CAST(n AS INTEGER) AS n, round(avg(CASE WHEN need > n THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS share_above FROM m CROSS JOIN range(1, 121) AS t(n) GROUP BY n""")
def required_size_exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = required_sample_sizes(spark, sf_dir).select(F.col("n_normal").alias("need"), F.explode(F.sequence(F.lit(1), F.lit(120))).alias("n"))
    return need.groupBy("n").agg(six(share(F.col("need") > F.col("n"))).alias("share_above"))


_GLS = """, o AS (SELECT sensor_id, date, value, lag(value) OVER w AS pv, date_diff('day', lag(date) OVER w, date) AS gap FROM d WINDOW w AS (PARTITION BY sensor_id ORDER BY date)),
c AS (SELECT sensor_id, count(*) AS pairs, avg(value * pv) - avg(value) * avg(pv) AS cov, sqrt((avg(value * value) - avg(value) * avg(value)) * (avg(pv * pv) - avg(pv) * avg(pv))) AS sp FROM o WHERE gap = 1 GROUP BY 1),
h AS (SELECT o.sensor_id, coalesce(CASE WHEN pairs >= 3 AND sp > 1e-12 THEN greatest(-0.95, least(0.95, cov / sp)) END, 0) AS rho, o.date, value, pv, gap FROM o LEFT JOIN c ON c.sensor_id = o.sensor_id),
q AS (SELECT *, CASE WHEN gap IS NULL THEN 0 ELSE pow(CAST(rho AS DOUBLE), gap) END AS a FROM h),
s1 AS (SELECT sensor_id, any_value(rho) AS rho, count(*) AS n, stddev_samp(value) AS sd, 1 + sum(CASE WHEN gap IS NULL THEN 0 ELSE (1 - a) / (1 + a) END) AS info, sum(CASE WHEN gap IS NULL THEN value ELSE (value - a * pv) / (1 + a) END) AS num FROM q GROUP BY 1)"""


def _gls(d: DataFrame) -> DataFrame:
    """Mean and variance of each sensor's series under an AR(1) with gaps, whose precision is tridiagonal over the days seen."""
    w = Window.partitionBy("sensor_id").orderBy("date")
    o = d.select("sensor_id", "date", "value", F.lag("value").over(w).alias("pv"), F.datediff("date", F.lag("date").over(w)).alias("gap"))
    next_day = o.where("gap = 1").groupBy("sensor_id").agg(correlation("value", "pv").alias("r"))
    o = o.join(next_day, "sensor_id", "left").withColumn("rho", F.coalesce(F.greatest(F.lit(-0.95), F.least(F.lit(0.95), F.col("r"))), F.lit(0.0)))
    first = F.col("gap").isNull()
    o = o.withColumn("a", F.when(first, F.lit(0.0)).otherwise(F.pow("rho", F.col("gap").cast("double"))))
    info = 1 + F.sum(F.when(first, F.lit(0.0)).otherwise((1 - F.col("a")) / (1 + F.col("a"))))
    total = F.sum(F.when(first, F.col("value")).otherwise((F.col("value") - F.col("a") * F.col("pv")) / (1 + F.col("a"))))
    return o.groupBy("sensor_id").agg(F.max("rho").alias("rho"), F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"), info.alias("info"), total.alias("num"))


@query(W + _GLS + " SELECT sensor_id, n, round(rho, 5) AS rho, round(num / info, 5) AS gls_mean, round(sd / sqrt(info), 5) AS gls_se, round(greatest(2, least(n, n * (1 - rho) / (1 + rho))), 4) AS n_effective FROM s1 WHERE n >= 3")
def ar1_gls(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gls(daily(readings(spark, sf_dir))).where("n >= 3")
    eff = F.greatest(F.lit(2.0), F.least(F.col("n").cast("double"), F.col("n") * (1 - F.col("rho")) / (1 + F.col("rho"))))
    return g.select("sensor_id", "n", F.round("rho", 5).alias("rho"), F.round(F.col("num") / F.col("info"), 5).alias("gls_mean"), F.round(F.col("sd") / F.sqrt("info"), 5).alias("gls_se"), F.round(eff, 4).alias("n_effective"))


def t_bound(p: Column, df: Column) -> Column:
    """Student's t quantile of a column of probabilities, by the Cornish-Fisher expansion from an expression of the normal one."""
    # Abramowitz and Stegun 26.2.23
    t = F.sqrt(-2 * F.ln(1 - p))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    third, fifth = F.pow(z, F.lit(3)), F.pow(z, F.lit(5))
    return z + (third + z) / (4 * df) + (5 * fifth + 16 * third + 3 * z) / (96 * df * df)


@query(W + _GLS + """, t AS (SELECT avg(value) AS ref FROM d), u AS (SELECT sensor_id, n, num / info AS m, sd / sqrt(info) AS se FROM s1 WHERE n >= 3), k AS (SELECT count(*) AS k FROM u), x AS (SELECT u.*, ref, sqrt(-2 * ln(0.025::DOUBLE / k)) AS w, CAST(n - 1 AS DOUBLE) AS df FROM u CROSS JOIN t CROSS JOIN k),
y AS (SELECT *, w - (2.515517::DOUBLE + 0.802853::DOUBLE * w + 0.010328::DOUBLE * w * w) / (1 + 1.432788::DOUBLE * w + 0.189269::DOUBLE * w * w + 0.001308::DOUBLE * w * w * w) AS z FROM x) SELECT count(*) AS n_sensors, count(CASE WHEN abs(m - ref) > (z + (pow(z, 3) + z) / (4 * df) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * df * df)) * se THEN 1 END) AS n_outside FROM y""")
def bonferroni_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors whose t interval, corrected for as many tests as there are sensors, excludes the network mean."""
    d = daily(readings(spark, sf_dir))
    tests = d.groupBy("sensor_id").agg(F.count("value").alias("n")).where("n >= 3").agg(F.count(F.lit(1)).alias("tests"))
    u = _gls(d).where("n >= 3").crossJoin(F.broadcast(d.agg(F.avg("value").alias("ref")))).crossJoin(F.broadcast(tests))  # a row each
    bound = t_bound(1 - F.lit(0.025) / F.col("tests"), (F.col("n") - 1).cast("double"))
    out = F.abs(F.col("num") / F.col("info") - F.col("ref")) > bound * F.col("sd") / F.sqrt("info")
    return u.agg(F.count(F.lit(1)).alias("n_sensors"), F.count_if(out).alias("n_outside"))


@query(W + """, x AS (SELECT city, date_diff('day', (SELECT lo FROM b), date) AS t, avg(value) AS v FROM d GROUP BY 1, 2) SELECT city, count(*) AS n, round(regr_slope(v, t), 6) AS slope, round(regr_intercept(v, t), 6) AS intercept, round(regr_r2(v, t), 6) AS r2,
round(sqrt((1 - regr_r2(v, t)) * regr_syy(v, t) / (count(*) - 2) / regr_sxx(v, t)), 6) AS slope_se FROM x GROUP BY city HAVING count(*) > 2""")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(readings(spark, sf_dir))
    lo = d.agg(F.min("date").alias("lo"))
    x = d.groupBy("city", "date").agg(F.avg("value").alias("v")).crossJoin(F.broadcast(lo)).withColumn("t", F.datediff("date", "lo").cast("double"))
    r2 = F.regr_r2("v", "t")
    g = x.groupBy("city").agg(F.count(F.lit(1)).alias("n"), six(F.regr_slope("v", "t")).alias("slope"), six(F.regr_intercept("v", "t")).alias("intercept"), six(r2).alias("r2"), six(F.sqrt((1 - r2) * F.regr_syy("v", "t") / (F.count(F.lit(1)) - 2) / F.regr_sxx("v", "t"))).alias("slope_se"))
    return g.where("n > 2")


@query(W + """, n AS (SELECT city, date, count(*) AS k, avg(value) AS m, stddev_samp(value) AS s FROM d GROUP BY 1, 2) SELECT city, count(*) AS n, round(corr(m, s), 6) AS r_mean_sd, round(corr(m, k), 6) AS r_mean_count, round(regr_slope(s, m), 6) AS sd_per_mean FROM n WHERE s IS NOT NULL GROUP BY city""")
def daily_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = daily(readings(spark, sf_dir)).groupBy("city", "date").agg(F.count(F.lit(1)).alias("k"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where("s IS NOT NULL")
    return n.groupBy("city").agg(F.count(F.lit(1)).alias("n"), six(correlation("m", "s")).alias("r_mean_sd"), six(correlation("m", "k")).alias("r_mean_count"), six(F.regr_slope("s", "m")).alias("sd_per_mean"))


@query(W + f""", n AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, avg(value) AS v, count(*) OVER () AS n FROM d GROUP BY date), k AS (SELECT draw, j, CAST('0x' || substr(md5('{SEED}|boot|' || draw || '|' || j), 1, 8) AS BIGINT) % n AS i FROM range(1, {DRAWS + 1}) AS a(draw), (SELECT i AS j, n FROM n)),
m AS (SELECT draw, avg(v) AS m FROM k JOIN n ON n.i = k.i GROUP BY draw) SELECT count(*) AS n_draws, round(quantile_cont(m, 0.025), 6) AS lower, round(median(m), 6) AS middle, round(quantile_cont(m, 0.975), 6) AS upper FROM m""")
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentile interval of the mean of daily network means; the days of a draw come from hashes."""
    n = daily(readings(spark, sf_dir)).groupBy("date").agg(F.avg("value").alias("v"))
    n = n.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # a row per day of the period
    size = n.agg(F.count(F.lit(1)).alias("n"))
    k = n.select(F.col("i").alias("j")).crossJoin(F.broadcast(size)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(DRAWS))))
    key = F.md5(F.concat_ws("|", F.lit(f"{SEED}|boot"), F.col("draw").cast("string"), F.col("j").cast("string")))
    k = k.select("draw", (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.col("n")).alias("i"))
    m = k.join(n, "i").groupBy("draw").agg(F.avg("v").alias("m"))
    q = lambda p: six(F.percentile("m", F.lit(p)))
    return m.agg(F.count(F.lit(1)).alias("n_draws"), q(0.025).alias("lower"), q(0.5).alias("middle"), q(0.975).alias("upper"))


@query(W + """, v AS (SELECT date, value, ln(value) AS l, median(value) OVER (PARTITION BY date) AS med, median(ln(value)) OVER (PARTITION BY date) AS lmed FROM d WHERE value > 0), w AS (SELECT *, median(abs(l - lmed)) OVER (PARTITION BY date) AS mad FROM v)
SELECT date, count(*) AS n, round(avg(value), 6) AS mean, round(max(med), 6) AS median, round(exp(avg(l) + var_samp(l) / 2), 5) AS lognormal, round(exp(max(lmed) + pow(1.4826 * max(mad), 2) / 2), 5) AS robust_lognormal FROM w GROUP BY date HAVING count(*) > 1""")
def daily_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four estimators of a day's mean: mean, median, lognormal, and lognormal by median and MAD."""
    v = daily(readings(spark, sf_dir)).where("value > 0").select("date", "value", F.ln("value").alias("l"))
    v = v.join(v.groupBy("date").agg(F.percentile("l", F.lit(0.5)).alias("lmed")), "date")
    l = F.col("l")  # noqa: E741
    g = v.groupBy("date").agg(F.count(F.lit(1)).alias("n"), six(F.avg("value")).alias("mean"), six(F.percentile("value", F.lit(0.5))).alias("median"), F.round(F.exp(F.avg(l) + F.var_samp(l) / 2), 5).alias("lognormal"), F.max("lmed").alias("lmed"), F.percentile(F.abs(l - F.col("lmed")), F.lit(0.5)).alias("mad"))
    robust = F.round(F.exp(F.col("lmed") + F.pow(1.4826 * F.col("mad"), F.lit(2)) / 2), 5)
    return g.where("n > 1").select("date", "n", "mean", "median", "lognormal", robust.alias("robust_lognormal"))


@query()
def sensor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors by k-means over their standardised mean, spread and uptime; profiles of the clusters."""
    g = grid(daily(readings(spark, sf_dir))).groupBy("sensor_id", "city").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), share(F.col("value").isNotNull()).alias("uptime")).where("sd IS NOT NULL")
    names = ["mean", "sd", "uptime"]
    stats = g.agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = g.crossJoin(F.broadcast(stats)).select("sensor_id", "city", *names, *[F.coalesce(ratio(F.col(c) - F.col(f"{c}_m"), f"{c}_s"), F.lit(0.0)).alias(f"z_{c}") for c in names])
    z = VectorAssembler(inputCols=[f"z_{c}" for c in names], outputCol="features").transform(z)
    found = KMeans(k=3, seed=SEED, maxIter=50).fit(z).transform(z)
    out = found.groupBy(F.col("prediction").alias("cluster"))
    return out.agg(F.count(F.lit(1)).alias("n"), six(F.avg("mean")).alias("mean"), six(F.avg("sd")).alias("sd"), six(F.avg("uptime")).alias("uptime"), F.mode("city", True).alias("main_city"))


@query()
def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means over the embedding table and the purity of its clusters by label."""
    e = load(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", "label", array_to_vector("embedding").alias("features"))
    found = KMeans(k=8, seed=SEED, maxIter=20).fit(e).transform(e)
    sizes = found.groupBy(F.col("prediction").alias("cluster"), "label").agg(F.count(F.lit(1)).alias("k"))
    return sizes.groupBy("cluster").agg(F.sum("k").alias("n"), F.max_by("label", F.struct("k", -F.col("label"))).alias("main_label"), six(ratio(F.max("k"), F.sum("k"))).alias("purity"))

"""Aggregates over the panel: daily and period means, profiles, completeness, screens and reference means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.functions.exprs import average_rank, collocation_group, correlation, monday, percent, ratio, season
from stationwise.plans.registry import READINGS_SQL, query
from stationwise.sources.panel import daily, grid, load, mean, readings

W = f"WITH {READINGS_SQL} "


def six(c) -> F.Column:
    return F.round(c, 6)


def share(condition) -> F.Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


@query(W + "SELECT sensor_id, date, n, hours, round(value, 6) AS value FROM d")
def daily_sensor_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(readings(spark, sf_dir)).select("sensor_id", "date", "n", "hours", six("value").alias("value"))


@query(W + """SELECT date, count(*) AS n_slots, count(value) AS n_sensors, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd,
  round(stddev_samp(value) / avg(value), 6) AS cv, round(1 - count(value) / CAST(count(*) AS DOUBLE), 6) AS missing_fraction FROM grid GROUP BY date""")
def daily_network_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(daily(readings(spark, sf_dir))).groupBy("date")
    return g.agg(F.count(F.lit(1)).alias("n_slots"), F.count("value").alias("n_sensors"), six(F.avg("value")).alias("mean"), six(F.percentile("value", F.lit(0.5))).alias("median"), six(F.stddev_samp("value")).alias("sd"), six(ratio(F.stddev_samp("value"), F.avg("value"))).alias("cv"), six(1 - ratio(F.count("value"), F.count(F.lit(1)))).alias("missing_fraction"))


@query(W + "SELECT sensor_id, date, hours FROM grid")
def valid_hour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(daily(readings(spark, sf_dir))).select("sensor_id", "date", "hours")


@query(W + "SELECT sensor_id, round(avg(least(1.0::DOUBLE, hours / CAST(24 AS DOUBLE))), 6) AS availability, round(avg(CASE WHEN value IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS uptime FROM grid GROUP BY sensor_id")
def daily_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(daily(readings(spark, sf_dir)))
    return g.groupBy("sensor_id").agg(six(F.avg(F.least(F.lit(1.0), F.col("hours") / 24))).alias("availability"), six(share(F.col("value").isNotNull())).alias("uptime"))


@query(W + "SELECT network, sensor_id, count(*) AS n, round(CAST(sum(cents) AS DOUBLE) / count(*) / 100, 6) AS value FROM r GROUP BY network, sensor_id")
def period_sensor_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).groupBy("network", "sensor_id").agg(F.count(F.lit(1)).alias("n"), six(mean()).alias("value"))


@query(W + "SELECT sensor_id, CAST(date - CAST((isodow(date) - 1) AS INTEGER) + (CASE WHEN isodow(date) = 1 THEN 0 ELSE 7 END) AS DATE) AS week, count(*) AS days, round(avg(value), 6) AS value FROM d GROUP BY 1, 2")
def weekly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(readings(spark, sf_dir)).groupBy("sensor_id", monday("date").alias("week")).agg(F.count(F.lit(1)).alias("days"), six(F.avg("value")).alias("value"))


LINES = """WITH l AS (SELECT l_suppkey AS sensor_id, CAST(l_shipdate AS DATE) AS date, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
d AS (SELECT sensor_id, date, CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS value FROM l GROUP BY 1, 2)"""


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second panel with a daily source: line items by supplier and ship date."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sensor_id"), F.to_date("l_shipdate").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return lines.groupBy("sensor_id", "date").agg(mean().alias("value"))


@query(LINES + " SELECT strftime(date, '%Y-%m') AS period, count(*) AS n, count(DISTINCT sensor_id) AS n_sensors, round(avg(value), 4) AS value FROM d GROUP BY 1")
def monthly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = official(spark, sf_dir).groupBy(F.date_format("date", "yyyy-MM").alias("period"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sensor_id").alias("n_sensors"), F.round(F.avg("value"), 4).alias("value"))


@query(LINES + """, s AS (SELECT DISTINCT sensor_id FROM d), days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d),
g AS (SELECT s.sensor_id, days.date, d.value, CASE WHEN month(days.date) IN (12, 1, 2) THEN 'DJF' WHEN month(days.date) IN (3, 4, 5) THEN 'MAM' WHEN month(days.date) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season
  FROM s CROSS JOIN days LEFT JOIN d ON d.sensor_id = s.sensor_id AND d.date = days.date),
u AS (SELECT season, sensor_id, 100 * avg(CASE WHEN value IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS uptime, count(*) AS cells, count(value) AS valid FROM g GROUP BY 1, 2)
SELECT season, CAST(sum(cells) AS BIGINT) AS cells, round(100 - 100 * sum(valid) / CAST(sum(cells) AS DOUBLE), 6) AS missing_pct, round(median(uptime), 6) AS median_uptime_pct FROM u GROUP BY season""")
def seasonal_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = official(spark, sf_dir)
    bounds = d.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    cells = d.select("sensor_id").distinct().crossJoin(F.broadcast(bounds)).select("sensor_id", F.explode(F.sequence("lo", "hi")).alias("date"))
    g = cells.join(d, ["sensor_id", "date"], "left").withColumn("season", season(F.month("date")))
    u = g.groupBy("season", "sensor_id").agg((100 * share(F.col("value").isNotNull())).alias("uptime"), F.count(F.lit(1)).alias("cells"), F.count("value").alias("valid"))
    return u.groupBy("season").agg(F.sum("cells").alias("cells"), six(100 - percent(F.sum("valid"), F.sum("cells"))).alias("missing_pct"), six(F.percentile("uptime", F.lit(0.5))).alias("median_uptime_pct"))


@query(W + "SELECT hr, count(*) AS n, round(avg(cents / CAST(100 AS DOUBLE)), 6) AS mean, round(quantile_cont(cents / CAST(100 AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(cents / CAST(100 AS DOUBLE), 0.75), 6) AS p75 FROM r GROUP BY hr")
def diurnal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("cents") / 100
    return readings(spark, sf_dir).groupBy("hr").agg(F.count(F.lit(1)).alias("n"), six(F.avg(v)).alias("mean"), six(F.percentile(v, F.lit(0.25))).alias("p25"), six(F.percentile(v, F.lit(0.75))).alias("p75"))


@query(W + """, h AS (SELECT city, hr, CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS m FROM r GROUP BY city, hr),
k AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY m DESC, hr) AS top, row_number() OVER (PARTITION BY city ORDER BY m, hr) AS low FROM h)
SELECT city, max(CASE WHEN top = 1 THEN hr END) AS peak_hour, max(CASE WHEN low = 1 THEN hr END) AS trough_hour, round(max(m) - min(m), 6) AS amplitude FROM k GROUP BY city""")
def diurnal_peak_trough(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = readings(spark, sf_dir).groupBy("city", "hr").agg(mean().alias("m"))
    return h.groupBy("city").agg(F.max_by("hr", F.struct("m", -F.col("hr"))).alias("peak_hour"), F.min_by("hr", F.struct("m", "hr")).alias("trough_hour"), six(F.max("m") - F.min("m")).alias("amplitude"))


@query(W + "SELECT sensor_id, hr, count(*) AS n, round(CAST(sum(cents) AS DOUBLE) / count(*) / 100, 6) AS mean, round(median(cents / CAST(100 AS DOUBLE)), 6) AS median FROM r GROUP BY sensor_id, hr")
def sensor_hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).groupBy("sensor_id", "hr").agg(F.count(F.lit(1)).alias("n"), six(mean()).alias("mean"), six(F.percentile(F.col("cents") / 100, F.lit(0.5))).alias("median"))


@query("""WITH e AS (SELECT event_type AS network, user_id, ts, value FROM events), t AS (SELECT network, user_id, ts, count(*) AS k FROM e GROUP BY 1, 2, 3)
SELECT e.network, count(*) AS n_rows, count(value) AS n_values, count(DISTINCT user_id) AS n_sensors, CAST(date_diff('hour', date_trunc('hour', min(ts)), date_trunc('hour', max(ts))) + 1 AS BIGINT) AS expected_hours,
  count(CASE WHEN value < 0 THEN 1 END) AS n_negative, count(CASE WHEN value = 0 THEN 1 END) AS n_zero, count(CASE WHEN value > 100 THEN 1 END) AS n_over_100, count(CASE WHEN value > 250 THEN 1 END) AS n_over_250, count(CASE WHEN value > 500 THEN 1 END) AS n_over_500,
  min(value) AS lowest, max(value) AS highest, (SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM t WHERE t.network = e.network) AS n_repeated FROM e GROUP BY e.network""")
def qaqc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("network"), "user_id", "ts", "value")
    v = F.col("value")
    hours = (F.unix_timestamp(F.date_trunc("hour", F.max("ts")).cast("timestamp")) - F.unix_timestamp(F.date_trunc("hour", F.min("ts")).cast("timestamp"))) / 3600 + 1
    out = e.groupBy("network").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_values"), F.count_distinct("user_id").alias("n_sensors"), hours.cast("long").alias("expected_hours"), F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"),
        F.count_if(v > 100).alias("n_over_100"), F.count_if(v > 250).alias("n_over_250"), F.count_if(v > 500).alias("n_over_500"), F.min(v).alias("lowest"), F.max(v).alias("highest"),
    )
    repeated = e.groupBy("network", "user_id", "ts").agg((F.count(F.lit(1)) - 1).alias("k")).groupBy("network").agg(F.sum("k").alias("n_repeated"))
    return out.join(repeated, "network")


@query(W + """, u AS (SELECT city, sensor_id, avg(CASE WHEN value IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS up FROM grid GROUP BY 1, 2), n AS (SELECT city, date, count(value) AS k FROM grid GROUP BY 1, 2)
SELECT u.city, round(min(up), 6) AS uptime_min, round(quantile_cont(up, 0.25), 6) AS uptime_p25, round(median(up), 6) AS uptime_median, round(max(up), 6) AS uptime_max,
  (SELECT count(*) FROM n WHERE n.city = u.city AND k < 5) AS days_under_5, (SELECT count(*) FROM n WHERE n.city = u.city AND k < 20) AS days_under_20, (SELECT count(*) FROM n WHERE n.city = u.city AND k < 45) AS days_under_45 FROM u GROUP BY u.city""")
def missingness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(daily(readings(spark, sf_dir)))
    u = g.groupBy("city", "sensor_id").agg(share(F.col("value").isNotNull()).alias("up")).groupBy("city")
    u = u.agg(six(F.min("up")).alias("uptime_min"), six(F.percentile("up", F.lit(0.25))).alias("uptime_p25"), six(F.percentile("up", F.lit(0.5))).alias("uptime_median"), six(F.max("up")).alias("uptime_max"))
    n = g.groupBy("city", "date").agg(F.count("value").alias("k")).groupBy("city").agg(*[F.count_if(F.col("k") < x).alias(f"days_under_{x}") for x in (5, 20, 45)])
    return u.join(n, "city")


@query(W + """, c AS (SELECT sensor_id, city, count(*) - count(value) AS missing FROM grid GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY missing DESC, sensor_id) AS place, count(*) OVER (PARTITION BY city) AS n FROM c)
SELECT city, max(n) AS n_sensors, CAST(sum(missing) AS BIGINT) AS missing_cells, round(100 * sum(CASE WHEN place <= ceil(0.1 * n) THEN missing ELSE 0 END) / CAST(nullif(sum(missing), 0) AS DOUBLE), 6) AS top10_share_pct,
  round(100 * sum(CASE WHEN place <= ceil(0.2 * n) THEN missing ELSE 0 END) / CAST(nullif(sum(missing), 0) AS DOUBLE), 6) AS top20_share_pct FROM k GROUP BY city""")
def missing_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = grid(daily(readings(spark, sf_dir))).groupBy("sensor_id", "city").agg(F.count_if(F.col("value").isNull()).alias("missing"))
    k = c.withColumn("place", F.row_number().over(Window.partitionBy("city").orderBy(F.desc("missing"), "sensor_id"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("city")))
    top = lambda p: six(percent(F.sum(F.when(F.col("place") <= F.ceil(p * F.col("n")), F.col("missing")).otherwise(0)), F.sum("missing")))
    return k.groupBy("city").agg(F.max("n").alias("n_sensors"), F.sum("missing").alias("missing_cells"), top(0.1).alias("top10_share_pct"), top(0.2).alias("top20_share_pct"))


@query(W + """, u AS (SELECT sensor_id, avg(CASE WHEN value IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS up FROM grid GROUP BY 1), k AS (SELECT sensor_id FROM u WHERE up >= 0.9)
SELECT city, date, count(*) AS n_sensors, round(avg(value), 6) AS value FROM d WHERE sensor_id IN (SELECT sensor_id FROM k) GROUP BY 1, 2""")
def uptime_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(readings(spark, sf_dir))
    kept = grid(d).groupBy("sensor_id").agg(share(F.col("value").isNotNull()).alias("up")).where("up >= 0.9")
    return d.join(kept, "sensor_id", "left_semi").groupBy("city", "date").agg(F.count(F.lit(1)).alias("n_sensors"), six(F.avg("value")).alias("value"))


@query(W + """, se AS (SELECT sensor_id, CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS v, count(*) AS n FROM r GROUP BY 1), dm AS (SELECT date, avg(value) AS v FROM d GROUP BY 1), sd AS (SELECT sensor_id, avg(value) AS v FROM d GROUP BY 1)
SELECT round((SELECT avg(v) FROM se), 6) AS sensor_equal, round((SELECT CAST(sum(cents) AS DOUBLE) / count(*) / 100 FROM r), 6) AS observation_weighted, round((SELECT avg(v) FROM dm), 6) AS day_equal,
  round((SELECT avg(v) FROM sd), 6) AS sensor_equal_daily, round((SELECT median(v) FROM se), 6) AS sensor_median, round((SELECT avg(value) FROM d), 6) AS sensor_day_equal""")
def reference_estimands(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    d = daily(r)
    by_sensor = r.groupBy("sensor_id").agg(mean().alias("v")).agg(six(F.avg("v")).alias("sensor_equal"), six(F.percentile("v", F.lit(0.5))).alias("sensor_median"))
    by_day = d.groupBy("date").agg(F.avg("value").alias("v")).agg(six(F.avg("v")).alias("day_equal"))
    by_sensor_day = d.groupBy("sensor_id").agg(F.avg("value").alias("v")).agg(six(F.avg("v")).alias("sensor_equal_daily"))
    return r.agg(six(mean()).alias("observation_weighted")).crossJoin(by_sensor).crossJoin(by_day).crossJoin(by_sensor_day).crossJoin(d.agg(six(F.avg("value")).alias("sensor_day_equal")))  # single rows


@query(W + """, w AS (SELECT city, sensor_id, date, value, sum(value) OVER (PARTITION BY city, date) AS t, count(*) OVER (PARTITION BY city, date) AS n FROM d)
SELECT city, sensor_id, count(*) AS days, round(avg(abs((t - value) / (n - 1) - t / n)), 6) AS mean_shift, round(max(abs((t - value) / (n - 1) - t / n)), 6) AS max_shift FROM w WHERE n > 1 GROUP BY 1, 2""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("city", "date")
    d = daily(readings(spark, sf_dir)).withColumn("t", F.sum("value").over(w)).withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1")
    shift = F.abs((F.col("t") - F.col("value")) / (F.col("n") - 1) - F.col("t") / F.col("n"))
    return d.groupBy("city", "sensor_id").agg(F.count(F.lit(1)).alias("days"), six(F.avg(shift)).alias("mean_shift"), six(F.max(shift)).alias("max_shift"))


@query(W + """, m AS (SELECT date, median(value) AS med, count(*) AS n FROM d GROUP BY date)
SELECT sensor_id, count(*) AS n_days, count(CASE WHEN m.n - 1 >= 5 AND med >= 10 AND value < 0.2 * med THEN 1 END) AS n_low, count(CASE WHEN value < 1 THEN 1 END) AS n_under_1, count(CASE WHEN value < 5 THEN 1 END) AS n_under_5 FROM d JOIN m USING (date) GROUP BY sensor_id""")
def low_tail_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(readings(spark, sf_dir))
    m = d.groupBy("date").agg(F.percentile("value", F.lit(0.5)).alias("med"), F.count(F.lit(1)).alias("peers"))
    low = (F.col("peers") - 1 >= 5) & (F.col("med") >= 10) & (F.col("value") < 0.2 * F.col("med"))
    return d.join(m, "date").groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n_days"), F.count_if(low).alias("n_low"), F.count_if(F.col("value") < 1).alias("n_under_1"), F.count_if(F.col("value") < 5).alias("n_under_5"))


@query("""WITH e AS (SELECT 'Site ' || (user_id // 4) || ' Collocation ' || (user_id % 4) AS station, CAST(ts AS DATE) AS date, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE value IS NOT NULL)
SELECT regexp_replace(station, '\\s+Collocation\\s+\\d+\\s*$', ' Collocation') AS station, date, count(*) AS n, round(CAST(sum(cents) AS DOUBLE) / count(*) / 100, 6) AS value FROM e GROUP BY 1, 2""".replace("\\\\", "\\"))
def collapsed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("sensor_id").cast("long")
    r = readings(spark, sf_dir).withColumn("station", F.concat(F.lit("Site "), F.floor(i / 4).cast("string"), F.lit(" Collocation "), (i % 4).cast("string")))
    return r.groupBy(collocation_group("station").alias("station"), "date").agg(F.count(F.lit(1)).alias("n"), six(mean()).alias("value"))


@query(W + """, n AS (SELECT city, date, avg(value) AS v FROM d GROUP BY 1, 2), m AS (SELECT city, date, 1 - count(value) / CAST(count(*) AS DOUBLE) AS miss FROM grid GROUP BY 1, 2), x AS (SELECT n.city, n.date, v, miss FROM n JOIN m ON n.city = m.city AND n.date = m.date),
k AS (SELECT city, rank() OVER (PARTITION BY city ORDER BY v) + (count(*) OVER (PARTITION BY city, v) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (PARTITION BY city ORDER BY miss) + (count(*) OVER (PARTITION BY city, miss) - 1) / CAST(2 AS DOUBLE) AS b FROM x)
SELECT city, count(*) AS n_days, round(corr(a, b), 6) AS rho FROM k GROUP BY city""")
def spearman_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(daily(readings(spark, sf_dir)))
    x = g.groupBy("city", "date").agg(F.avg("value").alias("v"), (1 - ratio(F.count("value"), F.count(F.lit(1)))).alias("miss")).where("v IS NOT NULL")
    k = x.select("city", average_rank("v", "city").alias("a"), average_rank("miss", "city").alias("b"))
    return k.groupBy("city").agg(F.count(F.lit(1)).alias("n_days"), six(correlation("a", "b")).alias("rho"))


@query(W + """, n AS (SELECT city, date, avg(value) AS v, row_number() OVER (PARTITION BY city ORDER BY date) AS i FROM d GROUP BY 1, 2), lag AS (SELECT unnest(range(-14, 15)) AS k),
p AS (SELECT a.city, CAST(lag.k AS INTEGER) AS lag, a.v AS x, b.v AS y FROM n a CROSS JOIN lag JOIN n b ON a.city = b.city AND b.i = a.i + lag.k)
SELECT city, lag, count(*) AS n, round(corr(x, y), 6) AS r FROM p GROUP BY 1, 2""")
def lag_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = daily(readings(spark, sf_dir)).groupBy("city", "date").agg(F.avg("value").alias("v"))
    n = n.withColumn("i", F.row_number().over(Window.partitionBy("city").orderBy("date")))
    shifted = n.select("city", F.explode(F.sequence(F.lit(-14), F.lit(14))).alias("lag"), F.col("v").alias("x"), "i").withColumn("i", F.col("i") + F.col("lag"))
    pairs = shifted.join(n.select("city", "i", F.col("v").alias("y")), ["city", "i"])
    return pairs.groupBy("city", "lag").agg(F.count(F.lit(1)).alias("n"), six(correlation("x", "y")).alias("r"))


@query(W + """, x AS (SELECT sensor_id, date, value, avg(value) OVER (PARTITION BY sensor_id) AS m FROM grid)
SELECT date, count(value) AS n_observed, count(*) AS n_filled, round(avg(value), 6) AS observed_mean, round(avg(coalesce(value, m)), 6) AS filled_mean FROM x GROUP BY date""")
def mean_filled_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = grid(daily(readings(spark, sf_dir))).withColumn("m", F.avg("value").over(Window.partitionBy("sensor_id")))
    return x.groupBy("date").agg(F.count("value").alias("n_observed"), F.count(F.lit(1)).alias("n_filled"), six(F.avg("value")).alias("observed_mean"), six(F.avg(F.coalesce("value", "m"))).alias("filled_mean"))


@query(W + """, x AS (SELECT sensor_id, date, value, date_diff('day', (SELECT lo FROM b), date) AS t FROM grid),
y AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt, first_value(value IGNORE NULLS) OVER f AS fv, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER f AS ft
  FROM x WINDOW p AS (PARTITION BY sensor_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY sensor_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT sensor_id, date, round(CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN fv WHEN fv IS NULL THEN pv ELSE pv + (fv - pv) * (t - pt) / CAST(ft - pt AS DOUBLE) END, 6) AS value, value IS NULL AS filled FROM y""")
def interpolated_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = grid(daily(readings(spark, sf_dir))).withColumn("t", F.unix_date("date"))
    back = Window.partitionBy("sensor_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("sensor_id").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.struct("t", "value"))
    y = x.withColumn("p", F.last(known, ignorenulls=True).over(back)).withColumn("f", F.first(known, ignorenulls=True).over(ahead))
    blend = F.col("p.value") + (F.col("f.value") - F.col("p.value")) * (F.col("t") - F.col("p.t")) / (F.col("f.t") - F.col("p.t")).cast("double")
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("p").isNull(), F.col("f.value")).when(F.col("f").isNull(), F.col("p.value")).otherwise(blend)
    return y.select("sensor_id", "date", six(filled).alias("value"), F.col("value").isNull().alias("filled"))


@query(W + """, a AS (SELECT date, avg(CAST(cents AS DOUBLE)) / 100 AS v FROM r WHERE network = 'signup' GROUP BY 1), o AS (SELECT date, avg(CAST(cents AS DOUBLE)) / 100 AS v FROM r WHERE network <> 'signup' GROUP BY 1), j AS (SELECT o.v - a.v AS diff, a.v AS x, o.v AS y FROM a JOIN o USING (date))
SELECT count(*) AS n, round(avg(diff), 6) AS bias, round(median(diff), 6) AS median_diff, round(avg(abs(diff)), 6) AS mae, round(max(abs(diff)), 6) AS max_abs, round(quantile_cont(abs(diff), 0.95), 6) AS p95_abs, round(sqrt(avg(diff * diff)), 6) AS rmse, round(corr(x, y), 6) AS r FROM j""")
def reference_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    a = r.where("network = 'signup'").groupBy("date").agg(mean().alias("x"))
    o = r.where("network <> 'signup'").groupBy("date").agg(mean().alias("y"))
    j = a.join(o, "date").withColumn("d", F.col("y") - F.col("x"))
    size = F.abs("d")
    return j.agg(F.count(F.lit(1)).alias("n"), six(F.avg("d")).alias("bias"), six(F.percentile("d", F.lit(0.5))).alias("median_diff"), six(F.avg(size)).alias("mae"), six(F.max(size)).alias("max_abs"), six(F.percentile(size, F.lit(0.95))).alias("p95_abs"), six(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("rmse"), six(correlation("x", "y")).alias("r"))


@query(W + """SELECT date, round(avg(CASE WHEN city = 0 THEN value END), 6) AS city_0, round(avg(CASE WHEN city = 1 THEN value END), 6) AS city_1, round(avg(CASE WHEN city = 2 THEN value END), 6) AS city_2 FROM d GROUP BY date""")
def city_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = daily(readings(spark, sf_dir)).groupBy("date").pivot("city", [0, 1, 2]).agg(six(F.avg("value")))
    return wide.withColumnsRenamed({str(k): f"city_{k}" for k in range(3)})


@query(W + """, a AS (SELECT DISTINCT sensor_id FROM r WHERE network = 'signup'), o AS (SELECT DISTINCT sensor_id FROM r WHERE network = 'view')
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM o) UNION ALL SELECT 'first_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM o) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM o)""")
def sensor_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    a, o = (r.where(F.col("network") == n).select("sensor_id").distinct() for n in ("signup", "view"))
    parts = {"both": a.intersect(o), "first_only": a.subtract(o), "either": a.union(o).distinct()}
    out = None
    for name, rows in parts.items():
        count = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = count if out is None else out.union(count)
    return out

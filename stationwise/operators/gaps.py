"""Missing runs, episodes and completeness scenarios, by the gaps-and-islands method on the daily grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.functions.exprs import MONSOON, percent, ratio, season
from stationwise.operators.panel import share, six
from stationwise.plans.registry import READINGS_SQL, query
from stationwise.sources.panel import daily, grid, readings

ISLANDS = f"""WITH {READINGS_SQL}, m AS (SELECT *, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS miss FROM grid),
i AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY date) - sum(miss) OVER (PARTITION BY sensor_id ORDER BY date) AS island FROM m),
g AS (SELECT city, sensor_id, min(date) AS first_date, max(date) AS last_date, count(*) AS days FROM i WHERE miss = 1 GROUP BY city, sensor_id, island)"""

# The completeness scenarios, as hours a day, share of days and longest gap in days.
SCENARIOS = (("S0", 1, 0.0, None), ("S1", 2, 0.0, None), ("S2", 3, 0.0, None), ("S3", 1, 0.5, None), ("S4", 1, 0.75, None), ("S5", 1, 0.75, 30), ("S6", 1, 0.9, 3))


def runs(rows: DataFrame, flag: Column, keys: list[str], order: str, *aggregates: Column) -> DataFrame:
    """Maximal runs of rows with ``flag``, per ``keys`` in ``order``; rows must have no holes."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_hit", flag.cast("int")).withColumn("_island", F.row_number().over(w) - F.sum("_hit").over(w))
    return marked.where("_hit = 1").groupBy(*keys, "_island").agg(F.min(order).alias("first_date"), F.max(order).alias("last_date"), F.count(F.lit(1)).alias("days"), *aggregates).drop("_island")


def missing_runs(g: DataFrame) -> DataFrame:
    return runs(g, F.col("value").isNull(), ["city", "sensor_id"], "date")


@query(ISLANDS + " SELECT city, sensor_id, first_date, last_date, days FROM g")
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_runs(grid(daily(readings(spark, sf_dir))))


@query(ISLANDS + """ SELECT city, count(*) AS n_gaps, round(avg(days), 6) AS mean_days, round(median(days), 6) AS median_days, round(quantile_cont(CAST(days AS DOUBLE), 0.95), 6) AS p95_days, max(days) AS longest,
round(100 * sum(CASE WHEN days <= 1 THEN days ELSE 0 END) / CAST(sum(days) AS DOUBLE), 6) AS pct_day, round(100 * sum(CASE WHEN days BETWEEN 2 AND 7 THEN days ELSE 0 END) / CAST(sum(days) AS DOUBLE), 6) AS pct_week,
round(100 * sum(CASE WHEN days > 7 THEN days ELSE 0 END) / CAST(sum(days) AS DOUBLE), 6) AS pct_longer FROM g GROUP BY city""")
def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = missing_runs(grid(daily(readings(spark, sf_dir))))
    part = lambda c: six(percent(F.sum(F.when(c, F.col("days")).otherwise(0)), F.sum("days")))
    d = F.col("days")
    return g.groupBy("city").agg(F.count(F.lit(1)).alias("n_gaps"), six(F.avg(d)).alias("mean_days"), six(F.percentile(d, F.lit(0.5))).alias("median_days"), six(F.percentile(d, F.lit(0.95))).alias("p95_days"), F.max(d).alias("longest"), part(d <= 1).alias("pct_day"), part(d.between(2, 7)).alias("pct_week"), part(d > 7).alias("pct_longer"))


@query(ISLANDS + " SELECT s.city, s.sensor_id, coalesce(max(g.days), 0) AS longest FROM s LEFT JOIN g ON g.sensor_id = s.sensor_id GROUP BY 1, 2")
def longest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(daily(readings(spark, sf_dir)))
    most = missing_runs(g).groupBy("sensor_id").agg(F.max("days").alias("longest"))
    return g.select("city", "sensor_id").distinct().join(most, "sensor_id", "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


@query(ISLANDS + " SELECT city, sensor_id, first_date, last_date, days, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY city ORDER BY days DESC, first_date, sensor_id) AS INTEGER) AS place FROM g) WHERE place <= 30")
def top_gap_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("city").orderBy(F.desc("days"), "first_date", "sensor_id")
    return missing_runs(grid(daily(readings(spark, sf_dir)))).withColumn("place", F.row_number().over(w)).where("place <= 30")


@query(f"""WITH {READINGS_SQL}, n AS (SELECT city, date, 100 - 100 * count(value) / CAST(count(*) AS DOUBLE) AS miss FROM grid GROUP BY 1, 2), h AS (SELECT *, CASE WHEN miss >= 10 THEN 1 ELSE 0 END AS hit FROM n),
i AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY date) - sum(hit) OVER (PARTITION BY city ORDER BY date) AS island FROM h)
SELECT city, min(date) AS first_date, max(date) AS last_date, count(*) AS days, round(avg(miss), 6) AS mean_pct, round(max(miss), 6) AS max_pct FROM i WHERE hit = 1 GROUP BY city, island""")
def high_missing_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = grid(daily(readings(spark, sf_dir))).groupBy("city", "date").agg((100 - percent(F.count("value"), F.count(F.lit(1)))).alias("miss"))
    return runs(n, F.col("miss") >= 10, ["city"], "date", six(F.avg("miss")).alias("mean_pct"), six(F.max("miss")).alias("max_pct"))


@query(ISLANDS + ", k AS (SELECT s.sensor_id FROM s LEFT JOIN g ON g.sensor_id = s.sensor_id GROUP BY 1 HAVING coalesce(max(g.days), 0) <= 1) SELECT city, date, count(*) AS n_sensors, round(avg(value), 6) AS value FROM d WHERE sensor_id IN (SELECT sensor_id FROM k) GROUP BY 1, 2")
def max_gap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(readings(spark, sf_dir))
    long_ = missing_runs(grid(d)).where("days > 1").select("sensor_id").distinct()
    return d.join(long_, "sensor_id", "left_anti").groupBy("city", "date").agg(F.count(F.lit(1)).alias("n_sensors"), six(F.avg("value")).alias("value"))


def retained(g: DataFrame) -> DataFrame:
    """``(scenario, city, sensor_id, date, value)``: the sensor-days that each scenario keeps, in one pass over the grid."""
    limits = sorted({h for _, h, _, _ in SCENARIOS})
    each = g.withColumn("least_hours", F.explode(F.array(*map(F.lit, limits))))  # runs are found once for each limit of hours
    each = each.withColumn("value", F.when(F.col("hours") >= F.col("least_hours"), F.col("value")))
    w = Window.partitionBy("least_hours", "sensor_id")
    miss = F.col("value").isNull().cast("int")
    order = w.orderBy("date")
    each = each.withColumn("_island", F.row_number().over(order) - F.sum(miss).over(order)).withColumn("uptime", F.avg(1.0 - miss).over(w))
    each = each.withColumn("_run", F.sum(miss).over(Window.partitionBy("least_hours", "sensor_id", "_island"))).withColumn("gap", F.max("_run").over(w))
    rules = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(h).alias("h"), F.lit(u).alias("u"), F.lit(x).cast("int").alias("x")) for n, h, u, x in SCENARIOS])
    fits = lambda r: (r["h"] == F.col("least_hours")) & (F.col("uptime") >= r["u"]) & (F.col("uptime") > 0) & (r["x"].isNull() | (F.col("gap") <= r["x"]))
    return each.withColumn("rule", F.explode(F.filter(rules, fits))).select("rule.scenario", "city", "sensor_id", "date", "value")


def scenario_sql() -> str:
    rows = ", ".join(f"('{n}', {h}, {u}, {'NULL' if x is None else x})" for n, h, u, x in SCENARIOS)
    return f"""WITH {READINGS_SQL}, rule(scenario, lh, lu, mg) AS (VALUES {rows}), e AS (SELECT scenario, lu, mg, city, sensor_id, date, CASE WHEN hours >= lh THEN value END AS v FROM grid CROSS JOIN rule),
i AS (SELECT *, row_number() OVER w - sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER w AS island FROM e WINDOW w AS (PARTITION BY scenario, sensor_id ORDER BY date)),
q AS (SELECT scenario, sensor_id, island, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS run FROM i GROUP BY 1, 2, 3), p AS (SELECT scenario, sensor_id, max(run) AS gap FROM q GROUP BY 1, 2),
u AS (SELECT scenario, sensor_id, any_value(lu) AS lu, any_value(mg) AS mg, avg(CASE WHEN v IS NULL THEN CAST(0 AS DOUBLE) ELSE 1 END) AS up FROM e GROUP BY 1, 2),
k AS (SELECT u.scenario, u.sensor_id FROM u JOIN p USING (scenario, sensor_id) WHERE up >= lu AND up > 0 AND (mg IS NULL OR gap <= mg)), kept AS (SELECT e.* FROM e JOIN k USING (scenario, sensor_id))"""


@query(scenario_sql() + " SELECT scenario, city, count(DISTINCT sensor_id) AS n_sensors, count(v) AS n_values, round(avg(v), 6) AS mean, round(100 * avg(CASE WHEN v IS NULL THEN CAST(0 AS DOUBLE) ELSE 1 END), 6) AS valid_pct FROM kept GROUP BY 1, 2")
def completeness_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = retained(grid(daily(readings(spark, sf_dir)))).groupBy("scenario", "city")
    return k.agg(F.count_distinct("sensor_id").alias("n_sensors"), F.count("value").alias("n_values"), six(F.avg("value")).alias("mean"), six(100 * share(F.col("value").isNotNull())).alias("valid_pct"))


@query(scenario_sql() + ", m AS (SELECT scenario, date, avg(v) AS x FROM kept WHERE v IS NOT NULL GROUP BY 1, 2), z AS (SELECT date, x AS base FROM m WHERE scenario = 'S0') SELECT scenario, count(*) AS n_days, round(avg(x - base), 6) AS mean_shift, round(max(abs(x - base)), 6) AS max_shift FROM m JOIN z USING (date) GROUP BY scenario")
def scenario_reference_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = retained(grid(daily(readings(spark, sf_dir)))).where("value IS NOT NULL").groupBy("scenario", "date").agg(F.avg("value").alias("x"))
    base = F.max(F.when(F.col("scenario") == "S0", F.col("x"))).over(Window.partitionBy("date"))
    m = m.withColumn("shift", F.col("x") - base).where("shift IS NOT NULL")
    return m.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_days"), six(F.avg("shift")).alias("mean_shift"), six(F.max(F.abs("shift"))).alias("max_shift"))


def interval_sums(intervals: DataFrame, series: DataFrame, keys: list[str], order: str, first: str, last: str, value: str) -> DataFrame:
    """``intervals`` with ``_sum`` and ``_n``: the values of ``series(keys, order, value)`` from ``first`` to ``last``, nulls left out.

    ``series`` has a row for each step; running sums and two lookups for each interval replace a join by ranges.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    upto = lambda c, name: F.coalesce(F.sum(c).over(w), F.lit(0)).alias(name)
    own = F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("int")
    running = series.select(*keys, order, upto(F.col(value), "_s"), upto(own[1], "_c"), own[0].alias("_v"), own[1].alias("_h"))
    start = running.select(*keys, F.col(order).alias(first), (F.col("_s") - F.col("_v")).alias("_s0"), (F.col("_c") - F.col("_h")).alias("_c0"))
    end = running.select(*keys, F.col(order).alias(last), F.col("_s").alias("_s1"), F.col("_c").alias("_c1"))
    found = intervals.join(start, [*keys, first], "left").join(end, [*keys, last], "left")
    return found.withColumns({"_sum": F.col("_s1") - F.col("_s0"), "_n": F.col("_c1") - F.col("_c0")}).drop("_s0", "_s1", "_c0", "_c1")


@query(ISLANDS + """, n AS (SELECT city, date, avg(value) AS v FROM grid GROUP BY 1, 2), o AS (SELECT city, avg(v) AS overall FROM n GROUP BY 1), x AS (SELECT g.city, g.sensor_id, g.first_date, g.last_date, g.days, avg(v) AS during FROM g JOIN n ON n.city = g.city AND n.date BETWEEN g.first_date AND g.last_date GROUP BY 1, 2, 3, 4, 5)
SELECT x.city, sensor_id, first_date, last_date, days, CASE WHEN month(m) IN (12, 1, 2) THEN 'DJF' WHEN month(m) IN (3, 4, 5) THEN 'MAM' WHEN month(m) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, CASE WHEN month(m) IN (3, 4, 5) THEN 'pre_monsoon' WHEN month(m) BETWEEN 6 AND 9 THEN 'monsoon' WHEN month(m) IN (10, 11) THEN 'post_monsoon' ELSE 'winter' END AS monsoon_season,
round(during, 6) AS network_mean, round(overall, 6) AS overall_mean, round(during - overall, 6) AS difference FROM (SELECT *, first_date + CAST((days - 1) // 2 AS INTEGER) AS m FROM x) x JOIN o ON o.city = x.city""")
def gap_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps with the season of their middle, and the network's mean during each beside its mean over all days."""
    g = grid(daily(readings(spark, sf_dir)))
    n = g.groupBy("city", "date").agg(F.avg("value").alias("v"))
    overall = n.groupBy("city").agg(F.avg("v").alias("overall"))
    e = interval_sums(missing_runs(g), n, ["city"], "date", "first_date", "last_date", "v").join(overall, "city")
    middle = F.month(F.expr("date_add(first_date, CAST((days - 1) div 2 AS int))"))
    during = ratio("_sum", "_n")
    return e.select("city", "sensor_id", "first_date", "last_date", "days", season(middle).alias("season"), season(middle, MONSOON).alias("monsoon_season"), six(during).alias("network_mean"), six("overall").alias("overall_mean"), six(during - F.col("overall")).alias("difference"))


FILTER_SIZES = (1, 2, 3, 5, 8, 12, 20, 30)


@query(f"""WITH {READINGS_SQL}, c AS (SELECT city, sensor_id, count(*) - count(value) AS miss FROM grid GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY miss DESC, sensor_id) AS place FROM c),
f(n) AS (VALUES {", ".join(f"({n})" for n in FILTER_SIZES)}), e AS (SELECT f.n, g.city, g.date, count(*) AS cells, count(value) AS valid, avg(value) AS v FROM f JOIN k ON k.place > f.n JOIN grid g ON g.sensor_id = k.sensor_id GROUP BY 1, 2, 3),
z AS (SELECT city, date, avg(value) AS base FROM grid GROUP BY 1, 2)
SELECT e.city, e.n AS removed, round(100 - 100 * sum(valid) / CAST(sum(cells) AS DOUBLE), 6) AS missing_pct, round(avg(v - base), 6) AS mean_shift, round(sqrt(avg((v - base) * (v - base))), 6) AS rms_shift FROM e JOIN z ON z.city = e.city AND z.date = e.date GROUP BY 1, 2""")
def filter_search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate filters that remove the sensors with most missing days, all scored in one aggregate."""
    g = grid(daily(readings(spark, sf_dir)))
    c = g.groupBy("city", "sensor_id").agg(F.count_if(F.col("value").isNull()).alias("miss"))
    k = c.select("sensor_id", F.row_number().over(Window.partitionBy("city").orderBy(F.desc("miss"), "sensor_id")).alias("place"))
    kept = k.withColumn("removed", F.explode(F.filter(F.array(*map(F.lit, FILTER_SIZES)), lambda n: n < F.col("place"))))
    e = g.join(kept, "sensor_id").groupBy("removed", "city", "date").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("valid"), F.avg("value").alias("v"))
    z = g.groupBy("city", "date").agg(F.avg("value").alias("base"))
    shift = F.col("v") - F.col("base")
    return e.join(z, ["city", "date"]).groupBy("city", "removed").agg(six(100 - percent(F.sum("valid"), F.sum("cells"))).alias("missing_pct"), six(F.avg(shift)).alias("mean_shift"), six(F.sqrt(F.avg(shift * shift))).alias("rms_shift"))

"""Joins with checked keys, comparisons of two summaries, digests, ranks, bins and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.functions.exprs import percent
from stationwise.operators.panel import six
from stationwise.operators.spatial import PAIRS, distances
from stationwise.plans.registry import READINGS_SQL, query
from stationwise.sources.footers import column_statistics, footers
from stationwise.sources.panel import daily, grid, load, mean, readings, sites

W = f"WITH {READINGS_SQL} "


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` joined with at most one row of ``right`` each; a key that ``right`` repeats fails the job when it is met."""
    once = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in right.columns if c not in keys])).alias("_r"))
    once = once.where(F.coalesce(F.assert_true(F.col("_n") == 1, F.lit("the right side repeats a key")).cast("boolean"), F.lit(True)))
    return left.join(once.select(*keys, "_r.*"), keys, how)


@query("""SELECT n_name, c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def validated_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    customers = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = many_to_one(many_to_one(orders, customers, ["c_custkey"]), nations, ["n_nationkey"])
    return j.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("c").alias("cents"))


_TWO = ", a AS (SELECT date, sensor_id, avg(CAST(cents AS DOUBLE)) / 100 AS v FROM r WHERE network = 'view' GROUP BY 1, 2), o AS (SELECT date, sensor_id, avg(CAST(cents AS DOUBLE)) / 100 AS v FROM r WHERE network = 'click' GROUP BY 1, 2)"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = readings(spark, sf_dir)
    return tuple(r.where(F.col("network") == n).groupBy("date", "sensor_id").agg(mean().alias(v)) for n, v in (("view", "a"), ("click", "o")))


@query(W + _TWO + " SELECT coalesce(a.date, o.date) AS date, count(*) AS n, count(a.v) AS n_view, count(o.v) AS n_click, round(avg(a.v - o.v), 6) AS mean_delta FROM a FULL JOIN o ON a.date = o.date AND a.sensor_id = o.sensor_id GROUP BY 1")
def outer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, o = _two(spark, sf_dir)
    j = a.join(o, ["date", "sensor_id"], "full_outer")
    return j.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("n_view"), F.count("o").alias("n_click"), six(F.avg(F.col("a") - F.col("o"))).alias("mean_delta"))


@query(W + _TWO + ", u AS (SELECT date, sensor_id, v, 'view' AS source FROM a UNION ALL SELECT o.date, o.sensor_id, o.v, 'click' FROM o LEFT JOIN a ON a.date = o.date AND a.sensor_id = o.sensor_id WHERE a.v IS NULL) SELECT source, count(*) AS n, round(avg(v), 6) AS value FROM u GROUP BY source")
def override_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary, and of the other only the keys that the first lacks."""
    a, o = _two(spark, sf_dir)
    rest = o.join(a, ["date", "sensor_id"], "left_anti")
    u = a.select(F.col("a").alias("v"), F.lit("view").alias("source")).unionByName(rest.select(F.col("o").alias("v"), F.lit("click").alias("source")), allowMissingColumns=True)
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), six(F.avg("v")).alias("value"))


@query(W + ", k AS (SELECT date, count(*) AS n, substr(sha256(string_agg(sensor_id, ',' ORDER BY sensor_id)), 1, 16) AS digest FROM d GROUP BY date) SELECT digest, max(n) AS n_sensors, count(*) AS n_days, min(date) AS first_date FROM k GROUP BY digest")
def valid_sensor_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days grouped by the set of sensors that have a value, named by a digest of the sorted ids."""
    ids = F.array_sort(F.collect_list("sensor_id"))
    k = daily(readings(spark, sf_dir)).groupBy("date").agg(ids.alias("ids"))
    k = k.select("date", F.size("ids").cast("long").alias("n"), F.substring(F.sha2(F.array_join("ids", ","), 256), 1, 16).alias("digest"))
    return k.groupBy("digest").agg(F.max("n").alias("n_sensors"), F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_date"))


@query(W + ", x AS (SELECT sensor_id, ts, date_diff('microsecond', lag(ts) OVER (PARTITION BY sensor_id ORDER BY ts), ts) / CAST(1000000 AS DOUBLE) AS gap FROM r) SELECT sensor_id, count(gap) AS n_gaps, round(min(gap), 3) AS least, round(median(gap), 3) AS median, round(max(gap), 3) AS most FROM x GROUP BY sensor_id")
def time_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    x = readings(spark, sf_dir).select("sensor_id", ((us - F.lag(us).over(Window.partitionBy("sensor_id").orderBy("ts"))) / 1e6).alias("gap"))
    return x.groupBy("sensor_id").agg(F.count("gap").alias("n_gaps"), F.round(F.min("gap"), 3).alias("least"), F.round(F.percentile("gap", F.lit(0.5)), 3).alias("median"), F.round(F.max("gap"), 3).alias("most"))


@query(f"WITH {PAIRS}, q AS (SELECT city, round(km, 6) AS km FROM p) SELECT city, km, count(*) AS n, round(max(c), 6) AS ecdf FROM (SELECT *, cume_dist() OVER (PARTITION BY city ORDER BY km) AS c FROM q) GROUP BY 1, 2")
def distance_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a city's pairs at most so far apart: counts of equal distances, summed up."""
    q = distances(sites(readings(spark, sf_dir))).groupBy("city", six("km").alias("km")).agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("city").orderBy("km")
    return q.select("city", "km", "n", six(F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy("city"))).alias("ecdf"))


_P_BINS = ((0.0, "0-25"), (25.0, "25-50"), (50.0, "50-100"), (100.0, "100-200"), (200.0, "200+"))


@query(W + f""", bins(lo, label) AS (VALUES {", ".join(f"(CAST({lo} AS DOUBLE), '{name}')" for lo, name in _P_BINS)}), x AS (SELECT city, CASE WHEN value >= 200 THEN '200+' WHEN value >= 100 THEN '100-200' WHEN value >= 50 THEN '50-100' WHEN value >= 25 THEN '25-50' ELSE '0-25' END AS label, count(*) AS n FROM d GROUP BY 1, 2),
c AS (SELECT DISTINCT city FROM s) SELECT c.city, bins.label, coalesce(n, 0) AS n FROM c CROSS JOIN bins LEFT JOIN x ON x.city = c.city AND x.label = bins.label""")
def value_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor-days by class of value; classes without days are there with 0."""
    d = daily(readings(spark, sf_dir))
    label = F.lit(None).cast("string")
    for lo, name in _P_BINS:
        label = F.when(F.col("value") >= lo, F.lit(name)).otherwise(label)
    counts = d.groupBy("city", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = d.select("city").distinct().withColumn("label", F.explode(F.array(*[F.lit(n) for _, n in _P_BINS])))
    return every.join(counts, ["city", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(W + """, u AS (SELECT city, sensor_id, 100 - 100 * count(value) / CAST(count(*) AS DOUBLE) AS missing_pct, avg(value) AS m FROM grid GROUP BY 1, 2), k AS (SELECT 'most_missing' AS board, city, sensor_id, round(missing_pct, 6) AS score, row_number() OVER (PARTITION BY city ORDER BY missing_pct DESC, CAST(sensor_id AS BIGINT)) AS place FROM u
UNION ALL SELECT 'highest_mean', city, sensor_id, round(m, 6), row_number() OVER (PARTITION BY city ORDER BY round(m, 9) DESC, CAST(sensor_id AS BIGINT)) FROM u) SELECT board, city, sensor_id, score, CAST(place AS INTEGER) AS place FROM k WHERE place <= 15""")
def leaderboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = grid(daily(readings(spark, sf_dir))).groupBy("city", "sensor_id").agg((100 - percent(F.count("value"), F.count(F.lit(1)))).alias("most_missing"), F.avg("value").alias("highest_mean"))
    long = u.unpivot(["city", "sensor_id"], ["most_missing", "highest_mean"], "board", "score")
    w = Window.partitionBy("board", "city").orderBy(F.desc(F.round("score", 9)), F.col("sensor_id").cast("long"))
    return long.withColumn("place", F.row_number().over(w)).where("place <= 15").select("board", "city", "sensor_id", six("score").alias("score"), "place")


# The footers that are read: a table, its columns by role; and a table, a column, its value as a number in SQL.
_ROLES = (("events", ("user_id", "value", "ts")), ("orders", ("o_custkey", "o_totalprice", "o_orderdate")), ("lineitem", ("l_suppkey", "l_extendedprice", "l_shipdate")))
_RANGES = (
    ("events", "user_id", "{}"), ("events", "value", "{}"), ("events", "ts", "epoch_us({})"), ("orders", "o_orderkey", "{}"), ("orders", "o_totalprice", "{}"),
    ("lineitem", "l_quantity", "{}"), ("lineitem", "l_extendedprice", "{}"), ("documents", "doc_id", "{}"), ("documents", "n_chars", "{}"), ("labels", "quality", "{}"),
)


@query("WITH e AS (SELECT 'events' AS name, count(*) AS n_rows, count(user_id) AS n_keys, count(value) AS n_values, count(ts) AS n_times FROM events), o AS (SELECT 'orders', count(*), count(o_custkey), count(o_totalprice), count(o_orderdate) FROM orders), l AS (SELECT 'lineitem', count(*), count(l_suppkey), count(l_extendedprice), count(l_shipdate) FROM lineitem) SELECT * FROM e UNION ALL SELECT * FROM o UNION ALL SELECT * FROM l")
def column_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and values there are, per source table and role of a column, from the files' footers alone."""
    out = None
    for name, roles in _ROLES:
        known = column_statistics(footers(spark, f"{sf_dir}/{name}.parquet"))
        values = [F.max(F.when(F.col("column") == c, F.col("n_rows") - F.col("n_nulls"))).alias(n) for c, n in zip(roles, ("n_keys", "n_values", "n_times"), strict=True)]
        rows = known.agg(F.max("n_rows").alias("n_rows"), *values).select(F.lit(name).alias("name"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, '{c}' AS column, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, CAST({x.format(f'min({c})')} AS DOUBLE) AS least, CAST({x.format(f'max({c})')} AS DOUBLE) AS most FROM {t}" for t, c, x in _RANGES))
def footer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and ranges of columns of numbers, times (microseconds) and days, from the files' footers alone."""
    out = None
    for name in dict.fromkeys(t for t, _, _ in _RANGES):
        columns = [c for t, c, _ in _RANGES if t == name]
        known = column_statistics(footers(spark, f"{sf_dir}/{name}.parquet").where(F.col("column").isin(columns)))
        rows = known.select(F.lit(name).alias("name"), "column", "n_rows", "n_nulls", "least", "most")
        out = rows if out is None else out.unionByName(rows)
    return out

"""The search for sensor filters: some 170 candidates scored in one pass over the panel.

A filter is a condition over a sensor's scores, so a sensor carries a bit for each filter.  A block of a city's sensors is two
matrices, filters by sensors and sensors by days, and their products are the block's sums for each filter and day; sums of
blocks add up.  No row is made for a filter and a sensor-day.  Filters that keep the same sensors are told by a digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.functions.exprs import correlation, ratio
from stationwise.operators.gaps import ISLANDS, missing_runs, runs
from stationwise.operators.panel import six
from stationwise.operators.regression import POISSON, correlation_intervals
from stationwise.operators.sampling import DRAWS, SEED
from stationwise.plans.registry import query
from stationwise.sources.panel import daily, grid, readings

LEAST_KEPT, SENSOR_BLOCK, HIGH_MISSING = 30, 512, 0.25
# How many of a ranking's first sensors go, presences, gaps in days and correlations that a sensor may have.
REMOVED = (1, 2, 3, 4, 5, 7, 10, 12, 15, 20, 25, 30, 35, 40)
PRESENCES = (0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90)
GAPS, RHOS = (30, 45, 60, 90, 120, 150, 180, 240), (0.10, 0.20, 0.30, 0.40)
BOTH_PRESENCES, BOTH_GAPS, UNIONS = (0.50, 0.60, 0.75), (30, 60, 90, 120), (3, 5, 7, 10, 15, 20)
#: A sensor's scores, by which it is ranked from the highest down: its rank is ``p_`` and the name.
SCORES = ("record_missing", "daily_missing", "longest_gap", "late_missing", "high_cv_missing", "temporal_rho", "spatial_cv_rho")


def candidates() -> list[tuple[str, str, str]]:
    """``(name, family, condition)``: conditions under which a sensor stays, in SQL over its scores and ranks."""
    out = [("baseline", "baseline", "true")]
    out += [(f"worst_{s}_{k}", f"worst_{s}", f"p_{s} > {k}") for s in SCORES for k in REMOVED]
    for kind in ("record", "daily"):
        out += [(f"{kind}_presence_{round(100 * p)}", f"{kind}_presence", f"{kind}_presence >= {p}") for p in PRESENCES]
        out += [(f"{kind}_presence_{round(100 * p)}_gap_{g}", f"{kind}_presence_gap", f"{kind}_presence >= {p} AND longest_gap <= {g}") for p in BOTH_PRESENCES for g in BOTH_GAPS]
    out += [(f"gap_{g}", "gap", f"longest_gap <= {g}") for g in GAPS]
    for a, b in (("temporal_rho", "spatial_cv_rho"), ("late_missing", "high_cv_missing")):
        out += [(f"worst_{a}_or_{b}_{k}", f"worst_{a}_or_{b}", f"p_{a} > {k} AND p_{b} > {k}") for k in UNIONS]
    return out + [(f"{s}_below_{round(100 * r)}", f"{s}_below", f"{s} < {r}") for s in ("temporal_rho", "spatial_cv_rho") for r in RHOS]


CANDIDATES = candidates()
#: Four filters whose results get intervals, and rules in proportion to the network's size and period.
SENSITIVITY = [("baseline", "", "true"), ("worst_record_missing_5", "", "p_record_missing > 5"), ("record_presence_50", "", "record_presence >= 0.5"), ("daily_presence_50", "", "daily_presence >= 0.5")]
RULES = [
    ("baseline", "", "true"), ("daily_50_gap_quarter_period", "", "daily_presence >= 0.5 AND longest_gap <= ceil(0.25 * n_days)"), ("daily_50_gap_90", "", "daily_presence >= 0.5 AND longest_gap <= 90"),
    ("worst_daily_missing_21pct", "", "p_daily_missing > greatest(1, floor(0.21 * n_sensors + 0.5))"), ("worst_daily_missing_15", "", "p_daily_missing > least(15, n_sensors - 1)"),
]


def _rho(x: str, y: str, *by: str) -> tuple[Column, Column]:
    """Ranks of two columns among the rows that have the first."""
    null = F.col(x).isNull()
    known = [*by, null.cast("string")]
    same = lambda c: F.rank().over(Window.partitionBy(*known).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*known, c)) - 1) / 2
    return F.when(~null, same(x)), F.when(~null, same(y))


def sensor_scores(g: DataFrame) -> DataFrame:
    """``(city, sensor_id, n_sensors, n_days, presences, scores, ranks)`` of the daily grid; ranks past the last that a filter asks for are null."""
    days = g.groupBy("city", "date").agg(F.round(ratio(F.stddev_samp("value"), F.avg("value")), 9).alias("cv"))
    span = days.groupBy("city").agg(F.percentile("cv", F.lit(0.75)).alias("high"), F.count(F.lit(1)).alias("n_days"), F.date_sub(F.max("date"), F.floor(F.count(F.lit(1)) / 3).cast("int")).alias("late"))
    x = g.join(days.join(span, "city"), ["city", "date"]).withColumn("miss", 1 - F.col("hours") / 24)
    x = x.withColumn("day", F.datediff("date", F.lit("2024-01-01").cast("date")))
    by = ("city", "sensor_id")
    x = x.withColumns(dict(zip(("td", "tm", "sc", "sm"), (*_rho("day", "miss", *by), *_rho("cv", "miss", *by)), strict=True)))
    some = lambda c: F.round(F.avg(F.when(c, F.col("miss"))), 9)
    s = x.groupBy(*by).agg(
        F.first("n_days").alias("n_days"), F.round(F.avg("miss"), 9).alias("record_missing"), F.round(1 - F.count("value") / F.count(F.lit(1)), 9).alias("daily_missing"),
        F.coalesce(some(F.col("date") > F.col("late")), F.lit(0.0)).alias("late_missing"), F.coalesce(some(F.col("cv") >= F.col("high")), F.lit(0.0)).alias("high_cv_missing"),
        F.coalesce(F.round(correlation("td", "tm"), 9), F.lit(-2.0)).alias("temporal_rho"), F.coalesce(F.round(correlation("sc", "sm"), 9), F.lit(-2.0)).alias("spatial_cv_rho"),
    )
    gap = missing_runs(g).groupBy(*by).agg(F.max("days").alias("longest_gap"))
    s = s.join(gap, list(by), "left").withColumn("longest_gap", F.coalesce("longest_gap", F.lit(0)))
    s = s.join(s.groupBy("city").agg(F.count(F.lit(1)).alias("n_sensors")), "city")
    s = s.withColumns({"record_presence": F.round(1 - F.col("record_missing"), 9), "daily_presence": F.round(1 - F.col("daily_missing"), 9)})
    long = s.unpivot([*by, "n_sensors"], list(SCORES), "score", "x")
    place = F.row_number().over(Window.partitionBy("city", "score").orderBy(F.desc("x"), F.col("sensor_id").cast("long")))
    ranks = long.withColumn("place", place)
    places = ranks.groupBy(*by).agg(*[F.max(F.when(F.col("score") == n, F.col("place"))).alias(f"p_{n}") for n in SCORES])
    return s.join(places, list(by))


def filter_days(g: DataFrame, scores: DataFrame, filters: list[tuple[str, str, str]], block: int = SENSOR_BLOCK) -> DataFrame:
    """``(city, f, date, n_kept, mark, n_valid, mean, sd, miss)``: the network that each filter leaves, by day; ``mark`` tells sets of sensors apart."""
    kind = g.schema["city"].dataType.simpleString()
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day")
    series = g.groupBy("city", "sensor_id").agg(F.sort_array(F.collect_list(F.struct(day, "value", F.col("hours").cast("int").alias("hours")))).alias("days"))
    bits = scores.select("city", "sensor_id", F.ceil(F.col("n_sensors") / block).alias("blocks"), F.array(*[F.expr(c) for _, _, c in filters]).alias("keep"))
    rows = series.join(bits, ["city", "sensor_id"]).withColumn("block", F.pmod(F.xxhash64("sensor_id"), F.col("blocks")))
    dealt = rows.select("city", "block", F.xxhash64("sensor_id", F.lit(1)).alias("own"), "keep", "days")

    def sums(held: list[dict], city: pa.DataType) -> pa.RecordBatch:
        days = sorted({x["day"] for r in held for x in r["days"]})
        at = {d: k for k, d in enumerate(days)}
        value, there, hours = (np.zeros((len(held), len(days))) for _ in range(3))
        for k, r in enumerate(held):
            for x in r["days"]:
                if x["value"] is not None:
                    value[k, at[x["day"]]], there[k, at[x["day"]]] = x["value"], 1
                hours[k, at[x["day"]]] = x["hours"]
        keep = np.array([r["keep"] for r in held], bool).T
        marks = np.array([np.bitwise_xor.reduce(np.array([r["own"] for r, k in zip(held, row, strict=True) if k], np.int64), initial=0) for row in keep])
        weight = keep.astype(float)
        n, s, q, h = (weight @ m for m in (there, value, value * value, hours))
        f, d = (x.ravel() for x in np.meshgrid(np.arange(len(keep)), np.arange(len(days)), indexing="ij"))
        columns = [pa.array([held[0]["city"]] * len(f), city), pa.array(f.astype(np.int32)), pa.array(np.array(days, np.int32)[d], pa.date32()), pa.array(keep.sum(1)[f]), pa.array(marks[f]), pa.array(n.ravel().astype(np.int64))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(s.ravel()), pa.array(q.ravel()), pa.array(h.ravel().astype(np.int64))], ["city", "f", "date", "kept", "mark", "n", "s", "q", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            city = batch.schema.field("city").type
            for row in batch.to_pylist():
                if (row["city"], row["block"]) != key and held:
                    yield sums(held, city)
                    held = []
                key = row["city"], row["block"]
                held.append(row)
        if held:
            yield sums(held, city)

    parts = dealt.repartition("city", "block").sortWithinPartitions("city", "block").mapInArrow(run, f"city {kind}, f int, date date, kept long, mark long, n long, s double, q double, h long")
    t = parts.groupBy("city", "f", "date").agg(F.sum("kept").alias("n_kept"), F.bit_xor("mark").alias("mark"), *[F.sum(c).alias(c) for c in "nsqh"])
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))
    return t.select("city", "f", "date", "n_kept", "mark", F.col("n").alias("n_valid"), F.round(ratio("s", "n"), 9).alias("mean"), F.round(spread, 9).alias("sd"), F.round(1 - ratio("h", 24 * F.col("n_kept")), 9).alias("miss"))


_RHOS = {"pm_rho": "mean", "temporal_rho": "day", "spatial_cv_rho": "cv", "spatial_sd_rho": "sd"}


def filter_summary(days: DataFrame, filters: list[tuple[str, str, str]], least: int = LEAST_KEPT) -> DataFrame:
    """A row for each city and filter that keeps ``least`` sensors, and for the one of all sensors: completeness, how far daily means move, and how missingness goes with level, time and spread."""
    days = days.where((F.col("f") == 0) | (F.col("n_kept") >= least)).withColumns({"cv": F.round(ratio("sd", "mean"), 9), "day": F.datediff("date", F.lit("2024-01-01").cast("date"))})
    base = days.where("f = 0").select("city", "date", F.col("mean").alias("base"), F.col("miss").alias("base_miss"))
    x = days.join(base, ["city", "date"]).withColumns({"shift": F.col("mean") - F.col("base"), "better": F.col("base_miss") - F.col("miss")})
    for name, c in _RHOS.items():
        x = x.withColumns(dict(zip((f"{name}_a", f"{name}_b"), _rho(c, "miss", "city", "f"), strict=True)))
    q = lambda c, p: six(F.percentile(c, F.lit(p)))
    off = F.abs("shift")
    s = x.groupBy("city", "f").agg(
        F.max("n_kept").alias("n_kept"), F.max("mark").alias("mark"), six(100 * F.avg("miss")).alias("missing_mean"), q(100 * F.col("miss"), 0.5).alias("missing_median"), q(100 * F.col("miss"), 0.9).alias("missing_p90"),
        F.count_if(F.col("miss") >= HIGH_MISSING).alias("days_high"), F.min("n_valid").alias("valid_min"), q("n_valid", 0.5).alias("valid_median"), six(100 * F.avg("better")).alias("improvement"), six(F.avg("shift")).alias("bias"),
        six(F.avg(off)).alias("mae"), q(off, 0.95).alias("abs_p95"), six(F.max(off)).alias("abs_max"), F.round(correlation("base", "mean"), 5).alias("pearson"), *[F.round(correlation(f"{n}_a", f"{n}_b"), 5).alias(n) for n in _RHOS],
    )
    longest = runs(x, F.col("miss") >= HIGH_MISSING, ["city", "f"], "date").groupBy("city", "f").agg(F.max("days").alias("longest_high"))
    s = s.join(longest, ["city", "f"], "left").withColumn("longest_high", F.coalesce("longest_high", F.lit(0)))
    own = Window.partitionBy("city")
    reduced = {f"{n}_reduction": F.round(F.max(F.when(F.col("f") == 0, F.abs(n))).over(own) - F.abs(n), 5) for n in _RHOS}
    names = F.array(*[F.lit(n) for n, _, _ in filters])
    s = s.withColumns({**reduced, "filter": F.get(names, F.col("f")), "same_as": F.get(names, F.min("f").over(Window.partitionBy("city", "n_kept", "mark")))})
    return s.drop("f", "mark")


def _days_sql(filters: list[tuple[str, str, str]]) -> str:
    """SQL of ``filter_days`` as ``fd``: a row for each filter and sensor-day, which is what the library avoids."""
    rho = lambda x: f"rank() OVER (PARTITION BY city, sensor_id, {x} IS NULL ORDER BY {{}}) + (count(*) OVER (PARTITION BY city, sensor_id, {x} IS NULL, {{}}) - 1) / CAST(2 AS DOUBLE)"
    ranks = ", ".join(f"row_number() OVER (PARTITION BY city ORDER BY {n} DESC, CAST(sensor_id AS BIGINT)) AS p_{n}" for n in SCORES)
    corr = lambda a, b: f"CASE WHEN count({a}) >= 3 AND stddev_pop({a}) * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 1e-12 THEN round(corr({a}, {b}), 9) ELSE -2 END"
    return ISLANDS + f""", cd AS (SELECT city, date, round(stddev_samp(value) / avg(value), 9) AS cv FROM grid GROUP BY 1, 2), sp AS (SELECT city, quantile_cont(cv, 0.75) AS high, count(*) AS n_days, max(date) - CAST(floor(count(*) / CAST(3 AS DOUBLE)) AS INTEGER) AS late FROM cd GROUP BY 1),
x0 AS (SELECT grid.*, cv, high, n_days, late, 1 - hours / CAST(24 AS DOUBLE) AS miss, date_diff('day', DATE '2024-01-01', grid.date) AS day FROM grid JOIN cd ON cd.city = grid.city AND cd.date = grid.date JOIN sp ON sp.city = grid.city),
x1 AS (SELECT *, {rho("day").format("day", "day")} AS td, {rho("day").format("miss", "miss")} AS tm, CASE WHEN cv IS NOT NULL THEN {rho("cv").format("cv", "cv")} END AS sc, {rho("cv").format("miss", "miss")} AS sm FROM x0),
s0 AS (SELECT city, sensor_id, max(n_days) AS n_days, round(avg(miss), 9) AS record_missing, round(1 - count(value) / CAST(count(*) AS DOUBLE), 9) AS daily_missing, coalesce(round(avg(CASE WHEN date > late THEN miss END), 9), 0) AS late_missing, coalesce(round(avg(CASE WHEN cv >= high THEN miss END), 9), 0) AS high_cv_missing, {corr("td", "tm")} AS temporal_rho, {corr("sc", "sm")} AS spatial_cv_rho FROM x1 GROUP BY 1, 2),
s1 AS (SELECT s0.*, coalesce(longest, 0) AS longest_gap, round(1 - record_missing, 9) AS record_presence, round(1 - daily_missing, 9) AS daily_presence, count(*) OVER (PARTITION BY s0.city) AS n_sensors FROM s0 LEFT JOIN (SELECT sensor_id, max(days) AS longest FROM g GROUP BY 1) l ON l.sensor_id = s0.sensor_id), s2 AS (SELECT *, {ranks} FROM s1),
k AS (SELECT city, sensor_id, unnest([{", ".join(c for _, _, c in filters)}]) AS keep, CAST(unnest(range(0, {len(filters)})) AS INTEGER) AS f FROM s2), kept AS (SELECT city, f, count(*) AS n_kept, string_agg(sensor_id, ',' ORDER BY sensor_id) AS mark FROM k WHERE keep GROUP BY 1, 2),
fd AS (SELECT k.city, k.f, grid.date, max(n_kept) AS n_kept, max(mark) AS mark, count(value) AS n_valid, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, round(1 - sum(hours) / CAST(24 * count(*) AS DOUBLE), 9) AS miss FROM k JOIN kept ON kept.city = k.city AND kept.f = k.f JOIN grid ON grid.sensor_id = k.sensor_id WHERE keep GROUP BY 1, 2, 3)"""


def _summary_sql(filters: list[tuple[str, str, str]], least: int = LEAST_KEPT) -> str:
    rank = lambda x, c: f"rank() OVER (PARTITION BY city, f, {x} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY city, f, {x} IS NULL, {c}) - 1) / CAST(2 AS DOUBLE)"
    ranks = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {rank(c, c)} END AS {n}_a, CASE WHEN {c} IS NOT NULL THEN {rank(c, 'miss')} END AS {n}_b" for n, c in _RHOS.items())
    corr = lambda a, b: f"CASE WHEN count({a}) >= 3 AND stddev_pop({a}) * stddev_pop({b}) > 1e-12 THEN round(corr({a}, {b}), 5) END"
    names = "[" + ", ".join(f"'{n}'" for n, _, _ in filters) + "]"
    return _days_sql(filters) + f""", y0 AS (SELECT fd.*, base, base_miss, mean - base AS shift, base_miss - miss AS better, round(sd / mean, 9) AS cv, date_diff('day', DATE '2024-01-01', fd.date) AS day FROM fd JOIN (SELECT city, date, mean AS base, miss AS base_miss FROM fd WHERE f = 0) z ON z.city = fd.city AND z.date = fd.date WHERE f = 0 OR n_kept >= {least}),
y1 AS (SELECT *, {ranks}, CASE WHEN miss >= {HIGH_MISSING} THEN 1 ELSE 0 END AS hit FROM y0), li AS (SELECT *, row_number() OVER (PARTITION BY city, f ORDER BY date) - sum(hit) OVER (PARTITION BY city, f ORDER BY date) AS il FROM y1), lr AS (SELECT city, f, max(n) AS longest_high FROM (SELECT city, f, il, count(*) AS n FROM li WHERE hit = 1 GROUP BY 1, 2, 3) GROUP BY 1, 2),
t AS (SELECT y1.city, y1.f, max(n_kept) AS n_kept, max(mark) AS mark, round(100 * avg(miss), 6) AS missing_mean, round(median(100 * miss), 6) AS missing_median, round(quantile_cont(100 * miss, 0.9), 6) AS missing_p90, sum(hit) AS days_high, min(n_valid) AS valid_min, round(median(n_valid), 6) AS valid_median, round(100 * avg(better), 6) AS improvement, round(avg(shift), 6) AS bias,
round(avg(abs(shift)), 6) AS mae, round(quantile_cont(abs(shift), 0.95), 6) AS abs_p95, round(max(abs(shift)), 6) AS abs_max, {corr("base", "mean")} AS pearson, {", ".join(f"{corr(n + '_a', n + '_b')} AS {n}" for n in _RHOS)}, coalesce(max(longest_high), 0) AS longest_high FROM y1 LEFT JOIN lr ON lr.city = y1.city AND lr.f = y1.f GROUP BY 1, 2)
SELECT * EXCLUDE (f, mark), {names}[f + 1] AS filter, {names}[min(f) OVER (PARTITION BY city, mark) + 1] AS same_as, {", ".join(f"round(max(CASE WHEN f = 0 THEN abs({n}) END) OVER (PARTITION BY city) - abs({n}), 5) AS {n}_reduction" for n in _RHOS)} FROM t"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(daily(readings(spark, sf_dir)))


@query(_summary_sql(CANDIDATES))
def filter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates, scored in one pass."""
    g = _panel(spark, sf_dir)
    return filter_summary(filter_days(g, sensor_scores(g), CANDIDATES), CANDIDATES)


@query(_summary_sql(RULES, 1))
def proportional_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in proportion to each network's size and period beside absolute ones."""
    g = _panel(spark, sf_dir)
    return filter_summary(filter_days(g, sensor_scores(g), RULES), RULES, 1)


_W = " + ".join(f"CASE WHEN u >= CAST({p!r} AS DOUBLE) THEN 1 ELSE 0 END" for p in POISSON)
_CI = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {c}_{n}" for c in ("mean", "r") for p, n in ((0.025, "lower"), (0.5, "middle"), (0.975, "upper")))
_FOUR = "[" + ", ".join(f"'{n}'" for n, _, _ in SENSITIVITY) + "]"


@query(_days_sql(SENSITIVITY) + f""", y AS (SELECT fd.city, fd.f, fd.city || '|' || {_FOUR}[fd.f + 1] AS name, CAST(fd.date AS VARCHAR) AS key, abs(mean - base) AS x, miss AS y FROM fd JOIN (SELECT city, date, mean AS base FROM fd WHERE f = 0) z ON z.city = fd.city AND z.date = fd.date WHERE mean IS NOT NULL),
u AS (SELECT y.*, draw, CAST('0x' || substr(md5('{SEED}|boot|' || draw || '|' || key), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM y CROSS JOIN range(1, {DRAWS + 1}) AS t(draw)), w AS (SELECT name, draw, x, y, CAST({_W} AS DOUBLE) AS w FROM u),
mo AS (SELECT name, draw, sum(w) AS n, sum(w * x) / nullif(sum(w), 0) AS x, sum(w * y) / nullif(sum(w), 0) AS y, sum(w * x * x) / nullif(sum(w), 0) AS xx, sum(w * y * y) / nullif(sum(w), 0) AS yy, sum(w * x * y) / nullif(sum(w), 0) AS xy FROM w GROUP BY 1, 2), v AS (SELECT *, sqrt(greatest(0, xx - x * x) * greatest(0, yy - y * y)) AS spread FROM mo),
dr AS (SELECT name, x AS mean, CASE WHEN n >= 3 AND spread > 1e-9 THEN (xy - x * y) / spread END AS r FROM v), o AS (SELECT name, count(*) AS n_days, CASE WHEN count(*) >= 3 AND stddev_pop(x) * stddev_pop(y) > 1e-12 THEN round(corr(x, y), 6) END AS r FROM y GROUP BY 1), ci AS (SELECT name, count(r) AS n_draws, {_CI} FROM dr GROUP BY 1)
SELECT o.name, n_days, r, ci.* EXCLUDE (name) FROM o JOIN ci ON ci.name = o.name""")
def filter_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals, for four filters, of how far daily means move and of how that goes with missingness."""
    g = _panel(spark, sf_dir)
    days = filter_days(g, sensor_scores(g), SENSITIVITY)
    base = days.where("f = 0").select("city", "date", F.col("mean").alias("base"))
    names = F.array(*[F.lit(n) for n, _, _ in SENSITIVITY])
    x = days.where("mean IS NOT NULL").join(base, ["city", "date"])
    rows = x.select(F.concat_ws("|", F.col("city").cast("string"), F.get(names, F.col("f"))).alias("g"), F.col("date").cast("string").alias("key"), F.abs(F.col("mean") - F.col("base")).alias("x"), F.col("miss").alias("y"))
    return correlation_intervals(rows).withColumnRenamed("city", "name")

"""Least squares from Gram matrices that add up, and bootstrap intervals from Poisson weights that add up.

A partition's rows become one matrix of sums for each group and fold.  These are added by a shuffle of a few rows; a fold is taken
out by subtraction, the rest standardised from its own moments and solved.  The bootstrap gives each row a Poisson weight for each
draw from a hash, and a partition becomes a matrix of weighted sums, draws by moments, whatever its number of rows; these are
added by group and block of draws.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.functions.exprs import correlation, ratio
from stationwise.operators.panel import six
from stationwise.operators.sampling import DRAWS, SEED, _mix
from stationwise.plans.registry import READINGS_SQL, query
from stationwise.sources.panel import daily, grid, readings

FOLDS = 5
#: Predictors of log daily means, and those of them that are 0 or 1 and stay so.
FEATURES, BINARY = ("missing", "spread", "hours", "before", "day", "weekend"), ("weekend",)


def gram(df: DataFrame, keys: list[str], features: tuple[str, ...], target: str) -> DataFrame:
    """``(keys, _gram)``: the upper triangle of the products of ``(1, features, target)``, summed; rows without all of them do not count."""
    z = [F.lit(1.0), *(F.col(c).cast("double") for c in (*features, target))]
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in (*features, target)))
    sums = [F.sum(a * b) for i, a in enumerate(z) for b in z[i:]]
    return whole.groupBy(*keys).agg(F.array(*sums).alias("_gram"))


def _solved(g: np.ndarray, binary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Coefficients over standardised features, the features' means and spreads, and whether there are rows enough."""
    d = g.shape[0] - 2
    n = g[0, 0]
    mean = np.where(binary, 0.0, g[0, 1:-1] / n)
    var = np.diag(g)[1:-1] / n - (g[0, 1:-1] / n) ** 2
    sd = np.where(binary | (var <= 1e-12 * np.maximum(1, np.diag(g)[1:-1] / n)), 1.0, np.sqrt(np.maximum(var, 0)))
    t = np.zeros((d + 1, d + 1))  # standardised = raw @ t
    t[0, 0], t[0, 1:], t[range(1, d + 1), range(1, d + 1)] = 1, -mean / sd, 1 / sd
    return np.linalg.lstsq(t.T @ g[:-1, :-1] @ t, t.T @ g[:-1, -1], rcond=1e-11)[0], mean, sd, n > d + 1


def fold_models(df: DataFrame, group: str, fold: str, features: tuple[str, ...], target: str, binary: tuple[str, ...] = ()) -> DataFrame:
    """``(group, fold, beta, mean, sd)``: a model of all rows (fold null), and one for each fold without its rows.

    ``beta`` begins with the intercept; features are standardised by the rows that a model learns from, those named ``binary``
    are not.  A fold whose rest has no more rows than coefficients has no model.
    """
    d, is_binary = len(features), np.array([f in binary for f in features])
    at = np.triu_indices(d + 2)
    kind = df.schema[group].dataType.simpleString()
    sums = gram(df, [group, fold], features, target).groupBy(group).agg(F.collect_list(F.struct(F.col(fold).cast("int").alias("f"), "_gram")).alias("folds"))  # a matrix for each fold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = {}
                for x in row["folds"]:
                    m = np.zeros((d + 2, d + 2))
                    m[at] = x["_gram"]
                    parts[x["f"]] = m + np.triu(m, 1).T
                total = sum(parts.values())
                for f, g in [(None, total), *((f, total - m) for f, m in sorted(parts.items()) if len(parts) > 1)]:
                    beta, mean, sd, enough = _solved(g, is_binary)
                    if enough:
                        out.append((row[group], f, beta.tolist(), mean.tolist(), sd.tolist()))
            if out:
                lists = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.schema.field(group).type, pa.int32(), lists, lists, lists), strict=True)], [group, fold, "beta", "mean", "sd"])

    return sums.mapInArrow(run, f"`{group}` {kind}, `{fold}` int, beta array<double>, mean array<double>, sd array<double>")


def predicted(features: tuple[str, ...]) -> Column:
    """A model's prediction of a row that it is joined with."""
    terms = [F.get("beta", F.lit(k + 1)) * (F.col(f) - F.get("mean", F.lit(k))) / F.get("sd", F.lit(k)) for k, f in enumerate(features)]
    return sum(terms, F.get("beta", F.lit(0)))


def fit_metrics(y: Column, fit: Column, n_features: int, prefix: str) -> list[Column]:
    """R squared, the same adjusted, RMSE and MAE over rows that have a prediction."""
    y = F.when(fit.isNotNull(), y)
    off, n = y - fit, F.count(fit)
    r2 = 1 - ratio(F.sum(off * off), F.nullif(F.regr_syy(y, y), F.lit(0.0)))
    adjusted = F.when(n > n_features + 1, 1 - (1 - r2) * (n - 1) / (n - n_features - 1))
    return [F.round(c, 5).alias(f"{prefix}_{name}") for c, name in ((r2, "r2"), (adjusted, "adjusted_r2"), (F.sqrt(F.avg(off * off)), "rmse"), (F.avg(F.abs(off)), "mae"))]


def daily_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A city's days with the log of their mean, the predictors (the day before's among them) and the fold."""
    g = grid(daily(readings(spark, sf_dir)))
    n = g.groupBy("city", "date").agg(F.log1p(F.avg("value")).alias("y"), (1 - ratio(F.count("value"), F.count(F.lit(1)))).alias("missing"), F.stddev_samp("value").alias("spread"), F.avg("hours").alias("hours")).withColumn("before", F.lag("y").over(Window.partitionBy("city").orderBy("date")))
    fold = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("city").cast("string"), F.col("date").cast("string"))), 1, 6), 16, 10).cast("int") % FOLDS
    return n.withColumns({"day": F.datediff("date", F.lit("2024-01-01").cast("date")).cast("double"), "weekend": F.when(F.weekday("date") >= 5, 1.0).otherwise(0.0), "fold": fold})


def _sql() -> str:
    """The frame, its training sets (fold -1: all rows), their standardised normal equations, and Gauss-Jordan steps to the coefficients."""
    d = len(FEATURES)
    frame = f"""WITH {READINGS_SQL}, n AS (SELECT city, date, ln(1 + avg(value)) AS y, 1 - count(value) / CAST(count(*) AS DOUBLE) AS missing, stddev_samp(value) AS spread, avg(CAST(hours AS DOUBLE)) AS hours, lag(ln(1 + avg(value))) OVER (PARTITION BY city ORDER BY date) AS before, CAST(date_diff('day', DATE '2024-01-01', date) AS DOUBLE) AS day,
CASE WHEN isodow(date) >= 6 THEN CAST(1 AS DOUBLE) ELSE 0 END AS weekend, CAST(CAST('0x' || substr(md5(city || '|' || date), 1, 6) AS BIGINT) % {FOLDS} AS INTEGER) AS fold FROM grid GROUP BY 1, 2),
w AS (SELECT * FROM n WHERE y IS NOT NULL AND spread IS NOT NULL AND before IS NOT NULL), t AS (SELECT w.*, k AS model FROM w CROSS JOIN range(-1, {FOLDS}) AS r(k) WHERE k = -1 OR fold <> k),
m AS (SELECT city, model, count(*) AS rows, {", ".join(f"0.0::DOUBLE AS m_{f}, 1.0::DOUBLE AS s_{f}" if f in BINARY else f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) > 1e-6 THEN stddev_pop({f}) ELSE 1 END AS s_{f}" for f in FEATURES)} FROM t GROUP BY 1, 2 HAVING count(*) > {d + 1}),
z AS (SELECT t.city, t.model, y, 1.0::DOUBLE AS z0, {", ".join(f"({f} - m_{f}) / s_{f} AS z{k + 1}" for k, f in enumerate(FEATURES))} FROM t JOIN m ON m.city = t.city AND m.model = t.model),
a0 AS (SELECT city, model, [{", ".join("[" + ", ".join(f"sum(z{i} * {f'z{j}' if j <= d else 'y'})" for j in range(d + 2)) + "]" for i in range(d + 1))}] AS a FROM z GROUP BY 1, 2)"""
    for k in range(1, d + 2):
        frame += f", a{k} AS (SELECT city, model, list_transform(range(1, {d + 2}), lambda i: list_transform(range(1, {d + 3}), lambda j: CASE WHEN i = {k} THEN a[{k}][j] / a[{k}][{k}] ELSE a[i][j] - a[i][{k}] * a[{k}][j] / a[{k}][{k}] END)) AS a FROM a{k - 1})"
    return frame + f", be AS (SELECT a{d + 1}.city, a{d + 1}.model, list_transform(a, lambda r: r[{d + 2}]) AS b, m.* EXCLUDE (city, model) FROM a{d + 1} JOIN m ON m.city = a{d + 1}.city AND m.model = a{d + 1}.model)"


OLS = _sql()
_FIT_SQL = "b[1] + " + " + ".join(f"b[{k + 2}] * (w.{f} - m_{f}) / s_{f}" for k, f in enumerate(FEATURES))
_METRIC_SQL = "round(1 - sum(pow(y - {p}, 2)) / (count(*) * var_pop(y)), 5) AS {p}_r2, round(1 - sum(pow(y - {p}, 2)) / (count(*) * var_pop(y)) * (count(*) - 1) / (count(*) - " + str(len(FEATURES) + 1) + "), 5) AS {p}_adjusted_r2, round(sqrt(avg(pow(y - {p}, 2))), 5) AS {p}_rmse, round(avg(abs(y - {p})), 5) AS {p}_mae"


@query(OLS + " SELECT city, f AS feature, round(b[k + 1], 5) AS coefficient, round(mean, 5) AS mean, round(sd, 5) AS sd FROM (SELECT city, b, unnest(['intercept', " + ", ".join(f"'{f}'" for f in FEATURES) + f"]) AS f, unnest(range(0, {len(FEATURES) + 1})) AS k, unnest([NULL, " + ", ".join(f"m_{f}" for f in FEATURES) + "]) AS mean, unnest([NULL, " + ", ".join(f"s_{f}" for f in FEATURES) + "]) AS sd FROM be WHERE model = -1)")
def ols_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six predictors of log daily means, by city: coefficients over standardised features."""
    m = fold_models(daily_frame(spark, sf_dir), "city", "fold", FEATURES, "y", BINARY).where("fold IS NULL")
    rows = F.arrays_zip(F.array(*[F.lit(f) for f in ("intercept", *FEATURES)]).alias("feature"), F.col("beta").alias("coefficient"), F.concat(F.array(F.lit(None).cast("double")), "mean").alias("mean"), F.concat(F.array(F.lit(None).cast("double")), "sd").alias("sd"))
    five = lambda c: F.round(c, 5).alias(c)
    return m.select("city", F.inline(rows)).select("city", "feature", five("coefficient"), five("mean"), five("sd"))


_PREDICTED = f"p AS (SELECT w.city, y, {_FIT_SQL} AS fit FROM w JOIN be ON be.city = w.city AND be.model = -1), c AS (SELECT w.city, y, {_FIT_SQL} AS cv FROM w JOIN be ON be.city = w.city AND be.model = w.fold)"


@query(OLS + f", {_PREDICTED}, x AS (SELECT city, count(*) AS n, {_METRIC_SQL.format(p='fit')} FROM p GROUP BY 1), o AS (SELECT city, count(*) AS n_predicted, {_METRIC_SQL.format(p='cv')} FROM c GROUP BY 1) SELECT x.*, o.* EXCLUDE (city) FROM x JOIN o ON o.city = x.city")
def ols_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well six predictors fit log daily means, and how well they predict the fold that a model has not seen."""
    w = daily_frame(spark, sf_dir).where("y IS NOT NULL AND spread IS NOT NULL AND before IS NOT NULL")
    models = fold_models(w, "city", "fold", FEATURES, "y", BINARY)
    fit = lambda m, on, name: w.join(m, on).select("city", "date", predicted(FEATURES).alias(name))
    both = w.join(fit(models.where("fold IS NULL").drop("fold"), ["city"], "fit"), ["city", "date"]).join(fit(models.where("fold IS NOT NULL"), ["city", "fold"], "cv"), ["city", "date"], "left")
    return both.groupBy("city").agg(F.count("fit").alias("n"), *fit_metrics(F.col("y"), F.col("fit"), len(FEATURES), "fit"), F.count("cv").alias("n_predicted"), *fit_metrics(F.col("y"), F.col("cv"), len(FEATURES), "cv"))


#: Where the weights of a Poisson distribution of mean 1 end: P(weight <= k).
POISSON = tuple(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)]).tolist())
_MOMENTS, DRAW_BLOCK = 6, 500


def poisson_weights(keys: list[str], first: int, last: int, seed: int, mixed: bool) -> np.ndarray:
    """A row for each draw, a column for each key: weights from ``md5(seed|boot|draw|key)``, or ``mixed`` from cheaper hashes."""
    if mixed:
        own = np.array([int.from_bytes(hashlib.md5(k.encode()).digest()[:8], "big") for k in keys], np.uint64)
        draw = _mix(np.arange(first, last + 1, dtype=np.uint64) + _mix(np.array([seed], np.uint64)))
        u = (_mix(draw[:, None] ^ own[None, :]) >> np.uint64(32)).astype(float)
    else:
        blob = b"".join(hashlib.md5(f"{seed}|boot|{d}|{k}".encode()).digest()[:4] for d in range(first, last + 1) for k in keys)
        u = np.frombuffer(blob, ">u4").reshape(last - first + 1, len(keys)).astype(float)
    return np.searchsorted(np.array(POISSON), u / 4294967296.0, side="right")


def bootstrap_moments(rows: DataFrame, draws: int = DRAWS, seed: int = SEED, mixed: bool = False, block: int = DRAW_BLOCK) -> DataFrame:
    """``(g, draw, n, x, y, xx, yy, xy)``: weighted sums of ``rows(g, key, x, y)`` for each group and draw.

    What a task sends is a matrix for each of its groups and blocks of draws; it does not grow with the rows.
    """
    kind = rows.schema["g"].dataType.simpleString()
    blocks = range(1, draws + 1, block)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            g, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            m = np.stack([np.ones(len(x)), x, y, x * x, y * y, x * y], 1)
            at: dict = {}
            for k, v in enumerate(g):
                at.setdefault(v, []).append(k)
            for v, own in at.items():
                for a in range(0, len(own), 2_000):
                    some = own[a : a + 2_000]
                    for first in blocks:
                        w = poisson_weights([keys[k] for k in some], first, min(draws, first + block - 1), seed, mixed)
                        held[v, first] = held.get((v, first), 0) + w @ m[some]
            kinds = batch.schema.field(0).type
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], kinds), pa.array([k[1] for k in held], pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["g", "first", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = row["g"], row["first"]
                held[key] = held.get(key, 0) + np.frombuffer(row["sums"]).reshape(-1, _MOMENTS)
            kinds = batch.schema.field(0).type
        for (g, first), sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(sums), kinds), pa.array(np.arange(first, first + len(sums)), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], ["g", "draw", "n", "x", "y", "xx", "yy", "xy"])

    known = rows.where("x IS NOT NULL AND y IS NOT NULL").select("g", F.col("key").cast("string"), F.col("x").cast("double"), F.col("y").cast("double"))
    parts = known.mapInArrow(weigh, f"g {kind}, first int, sums binary").repartition("g", "first")
    return parts.mapInArrow(add, f"g {kind}, draw int, n double, x double, y double, xx double, yy double, xy double")


def weighted_correlation() -> Column:
    """Pearson's r from a draw's moments; null with a weight under 3 or without variance."""
    n = F.col("n")
    cov = F.col("xy") / n - F.col("x") / n * F.col("y") / n
    var = [F.greatest(F.lit(0.0), F.col(a + a) / n - F.col(a) / n * F.col(a) / n) for a in "xy"]
    spread = F.sqrt(var[0] * var[1])
    return F.when((n >= 3) & (spread > 1e-9), cov / F.nullif(spread, F.lit(0.0)))


_W = " + ".join(f"CASE WHEN u >= CAST({p!r} AS DOUBLE) THEN 1 ELSE 0 END" for p in POISSON)
BOOTSTRAP = f"""WITH {READINGS_SQL}, n AS (SELECT city, city || '|' || date AS key, avg(value) AS x, 1 - count(value) / CAST(count(*) AS DOUBLE) AS y FROM grid GROUP BY city, date HAVING count(value) > 0),
k AS (SELECT n.*, draw, CAST('0x' || substr(md5('{SEED}|boot|' || draw || '|' || key), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM n CROSS JOIN range(1, {DRAWS + 1}) AS t(draw)), w AS (SELECT city, draw, x, y, CAST({_W} AS DOUBLE) AS w FROM k),
m AS (SELECT city, draw, sum(w) AS n, sum(w * x) / nullif(sum(w), 0) AS x, sum(w * y) / nullif(sum(w), 0) AS y, sum(w * x * x) / nullif(sum(w), 0) AS xx, sum(w * y * y) / nullif(sum(w), 0) AS yy, sum(w * x * y) / nullif(sum(w), 0) AS xy FROM w GROUP BY 1, 2),
dr AS (SELECT city, x AS mean, CASE WHEN n >= 3 AND sqrt(greatest(0, xx - x * x) * greatest(0, yy - y * y)) > 1e-9 THEN (xy - x * y) / sqrt(greatest(0, xx - x * x) * greatest(0, yy - y * y)) END AS r FROM m)"""
_CI = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {c}_{n}" for c in ("mean", "r") for p, n in ((0.025, "lower"), (0.5, "middle"), (0.975, "upper")))


@query(BOOTSTRAP + f", o AS (SELECT city, count(*) AS n_days, round(corr(x, y), 6) AS r FROM n GROUP BY 1), c AS (SELECT city, count(r) AS n_draws, {_CI} FROM dr GROUP BY 1) SELECT o.*, c.* EXCLUDE (city) FROM o JOIN c ON c.city = o.city")
def bootstrap_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of a city's mean and of its correlation with the share of missing sensors."""
    return correlation_intervals(_bootstrap_rows(spark, sf_dir))


def _bootstrap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = grid(daily(readings(spark, sf_dir))).groupBy("city", "date").agg(F.avg("value").alias("x"), (1 - ratio(F.count("value"), F.count(F.lit(1)))).alias("y"), F.count("value").alias("seen")).where("seen > 0")
    return n.select(F.col("city").alias("g"), F.concat_ws("|", F.col("city").cast("string"), F.col("date").cast("string")).alias("key"), "x", "y")


def correlation_intervals(rows: DataFrame, draws: int = DRAWS, seed: int = SEED, mixed: bool = False) -> DataFrame:
    """By ``g`` (as ``city``): the correlation of ``x`` and ``y``, and intervals of it and of the mean of ``x`` over weighted draws."""
    m = bootstrap_moments(rows, draws, seed, mixed).select("g", ratio("x", "n").alias("mean"), weighted_correlation().alias("r"))
    q = lambda c, p, name: six(F.percentile(c, F.lit(p))).alias(f"{c}_{name}")
    c = m.groupBy("g").agg(F.count("r").alias("n_draws"), *[q(c, p, name) for c in ("mean", "r") for p, name in ((0.025, "lower"), (0.5, "middle"), (0.975, "upper"))])
    o = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n_days"), six(correlation("x", "y")).alias("r"))
    return o.join(c, "g").withColumnRenamed("g", "city")

"""Four estimators of a network's mean from the sensors of a draw: mean, median, lognormal, and lognormal by median and MAD.

A draw's sensors come one at a time, for all draws at once: the ranks of the values drawn so far are kept sorted, a new one is
inserted into every draw's row, and medians are read off the middle, so no size is sorted anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.operators.sampling import DRAWS, MAX_N, Network, drawn_sql, simulate
from stationwise.plans.registry import READINGS_SQL, query
from stationwise.sources.panel import daily, readings

SIZES = (2, 5, 10, 20)
NAMES = ("mean", "median", "lognormal", "robust_lognormal")
#: A normal distribution's standard deviation over its median absolute deviation.
MAD_SIGMA = 1.4826


class SortedRows:
    """Numbers inserted one for each row at a time, each row kept in order."""

    def __init__(self, rows: int, most: int, kind=np.int32):
        self.x, self.n, self._at = np.zeros((rows, most), kind), 0, np.arange(most)

    def insert(self, new: np.ndarray) -> None:
        held = self.x[:, : self.n]
        place = (held <= new[:, None]).sum(1)[:, None]
        at = self._at[: self.n + 1]
        moved = np.empty((len(new), self.n + 1), self.x.dtype)
        moved[:, 1:] = held
        moved[:, : self.n] = np.where(at[: self.n] < place, held, moved[:, : self.n]) if self.n else moved[:, :0]
        np.put_along_axis(moved, place, new[:, None].astype(self.x.dtype), 1)
        self.n += 1
        self.x[:, : self.n] = moved

    def middle(self) -> tuple[np.ndarray, np.ndarray]:
        """The one or two entries in the middle of each row."""
        return self.x[:, (self.n - 1) // 2], self.x[:, self.n // 2]


def estimates_by_size(c: np.ndarray, orders: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(n, [the four estimates of each draw])``; ``c`` are hundredths above 0."""
    by_rank = np.argsort(c, kind="stable")
    rank = np.empty(len(c), np.int32)
    rank[by_rank] = np.arange(len(c))
    value = np.sort(c) / 100
    log = np.log(value)
    held = SortedRows(len(orders), max((n for n in sizes if n <= orders.shape[1]), default=0))
    total, logs, squares = (np.zeros(len(orders)) for _ in range(3))
    for n in range(1, held.x.shape[1] + 1):
        new = rank[orders[:, n - 1]]
        held.insert(new)
        total, logs, squares = total + value[new], logs + log[new], squares + log[new] ** 2
        if n not in sizes:
            continue
        low, high = held.middle()
        log_median = (log[low] + log[high]) / 2
        deviation = np.abs(log[held.x[:, :n]] - log_median[:, None])
        mad = np.median(deviation, axis=1)
        variance = np.maximum(0, squares - logs * logs / n) / (n - 1) if n > 1 else np.full(len(orders), np.nan)
        yield n, [total / n, (value[low] + value[high]) / 2, np.exp(logs / n + variance / 2), np.exp(log_median + (MAD_SIGMA * mad) ** 2 / 2)]


def estimator_errors(sizes: tuple[int, ...]):
    """Relative bias and median error of each estimator and size against the network's mean."""

    def work(n, est, squares, net: Network, first) -> Iterator[tuple]:
        for k, found in estimates_by_size(net.c, net.orders, sizes):
            for name, e in enumerate(found):
                if np.isfinite(e).all() and net.ref:
                    yield k, name, 100 * (float(e.mean()) - net.ref) / net.ref, float(np.median(100 * np.abs(e - net.ref) / abs(net.ref)))

    return work


_CASES = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(NAMES))
ESTIMATORS = f"""WITH {READINGS_SQL}, v AS (SELECT city, date, sensor_id, CAST(round(value * 100) AS BIGINT) AS c FROM d WHERE round(value * 100) > 0), {drawn_sql("v", "city, date,")}, f AS (SELECT city, date, CAST(sum(c) AS DOUBLE) / count(*) / 100 AS ref FROM v GROUP BY 1, 2),
x AS (SELECT city, date, draw, s.n AS n, c / CAST(100 AS DOUBLE) AS v, ln(c / CAST(100 AS DOUBLE)) AS l FROM q JOIN (VALUES {", ".join(f"({n})" for n in SIZES)}) AS s(n) ON q.n <= s.n), y AS (SELECT *, median(l) OVER (PARTITION BY city, date, draw, n) AS lmed FROM x),
z AS (SELECT city, date, draw, n, [avg(v), median(v), exp(avg(l) + var_samp(l) / 2), exp(max(lmed) + pow({MAD_SIGMA}::DOUBLE * median(abs(l - lmed)), 2) / 2)] AS e FROM y GROUP BY 1, 2, 3, 4 HAVING count(*) = n),
u AS (SELECT city, date, n, k, e[k + 1] AS e FROM z CROSS JOIN range(0, {len(NAMES)}) AS r(k)), w AS (SELECT u.city, u.date, n, k, 100 * (avg(e) - max(ref)) / max(ref) AS bias, median(100 * abs(e - ref) / ref) AS mdape FROM u JOIN f ON f.city = u.city AND f.date = u.date GROUP BY 1, 2, 3, 4)"""


@query(ESTIMATORS + f" SELECT city, n, CASE k {_CASES} END AS estimator, count(*) AS n_days, round(median(bias), 5) AS bias_median, round(avg(bias), 5) AS bias_mean, round(median(mdape), 5) AS mdape_median, round(quantile_cont(mdape, 0.75), 5) AS mdape_p75 FROM w GROUP BY 1, 2, 3")
def mc_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far four estimators from draws of n sensors lie from a day's network mean; values of 0 or less are left out."""
    v = daily(readings(spark, sf_dir)).select("city", "date", "sensor_id", F.round(F.col("value") * 100).cast("long").alias("c")).where("c > 0")
    return estimator_summary(v)


def estimator_summary(v: DataFrame, sizes: tuple[int, ...] = SIZES, draws: int = DRAWS, most: int = MAX_N, mixed: bool = False) -> DataFrame:
    """By city, size and estimator over the days of ``v(city, date, sensor_id, c)``."""
    e = simulate(v, ("city", "date"), estimator_errors(sizes), "n int, k int, bias double, mdape double", draws, most, mixed=mixed)
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 5)
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), F.col("k") + 1)
    return e.groupBy("city", "n", name.alias("estimator")).agg(
        F.count(F.lit(1)).alias("n_days"), q("bias", 0.5).alias("bias_median"), F.round(F.avg("bias"), 5).alias("bias_mean"), q("mdape", 0.5).alias("mdape_median"), q("mdape", 0.75).alias("mdape_p75")
    )


_DIFFERENCES = ", ".join(f"round(median(100 * ({n} - mean) / mean), 5) AS {n}_difference" for n in NAMES[1:])


@query(f"""WITH {READINGS_SQL}, v AS (SELECT city, date, value, ln(value) AS l, median(ln(value)) OVER (PARTITION BY city, date) AS lmed FROM d WHERE value > 0), m AS (SELECT city, date, avg(value) AS mean, median(value) AS median, exp(avg(l) + var_samp(l) / 2) AS lognormal, exp(max(lmed) + pow({MAD_SIGMA}::DOUBLE * median(abs(l - lmed)), 2) / 2) AS robust_lognormal FROM v GROUP BY 1, 2 HAVING count(*) > 1)
SELECT city, count(*) AS n_days, round(median(mean), 5) AS mean_median, {_DIFFERENCES} FROM m GROUP BY 1""")
def network_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the other three estimators of all of a day's sensors differ from their mean, in per cent: the median over days."""
    v = daily(readings(spark, sf_dir)).where("value > 0").select("city", "date", "value", F.ln("value").alias("l"))
    v = v.join(v.groupBy("city", "date").agg(F.percentile("l", F.lit(0.5)).alias("lmed")), ["city", "date"])
    mad = F.percentile(F.abs(F.col("l") - F.col("lmed")), F.lit(0.5))
    m = v.groupBy("city", "date").agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.exp(F.avg("l") + F.var_samp("l") / 2).alias("lognormal"),
        F.exp(F.max("lmed") + F.pow(MAD_SIGMA * mad, F.lit(2)) / 2).alias("robust_lognormal"), F.count(F.lit(1)).alias("k"),
    ).where("k > 1")
    q = lambda c: F.round(F.percentile(c, F.lit(0.5)), 5)
    return m.groupBy("city").agg(F.count(F.lit(1)).alias("n_days"), q("mean").alias("mean_median"), *[q(100 * (F.col(n) - F.col("mean")) / F.col("mean")).alias(f"{n}_difference") for n in NAMES[1:]])

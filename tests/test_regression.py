"""Folded least squares and Poisson bootstraps against numpy over all rows at once."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationwise.operators import regression

FEATURES = ("a", "b", "c", "d", "e", "f")


def rows(n: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [rng.gauss(50, 9), rng.random(), rng.expovariate(0.01), float(rng.random() < 0.3), 7.0, rng.gauss(0, 1e-3)]
        y = None if i % 31 == 5 else 3 + 0.2 * x[0] - 4 * x[1] + 0.01 * x[2] + x[3] + 900 * x[5] + rng.gauss(0, 1)
        out.append((i % 2, i % 5, *x[:5], None if i % 37 == 3 else x[5], y))
    return out


def brute(train: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = np.array([r[2:-1] for r in train], float), np.array([r[-1] for r in train], float)
    mean, sd = x.mean(0), x.std(0)
    mean[3], sd[3], sd[4] = 0, 1, 1  # a binary column and a constant one
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(x)), (x - mean) / sd]), y, rcond=None)[0]
    return beta, mean, sd


def test_folds_against_fits_of_the_rest(spark):
    data = rows(300)
    df = spark.createDataFrame(data, "g int, fold int, a double, b double, c double, d double, e double, f double, y double").repartition(7)
    models = regression.fold_models(df, "g", "fold", FEATURES, "y", ("d",))
    got = {(r.g, r.fold): r for r in models.collect()}
    whole = [r for r in data if None not in r]
    assert set(got) == {(g, f) for g in (0, 1) for f in (None, 0, 1, 2, 3, 4)}
    fits = {}
    for (g, fold), r in got.items():
        beta, mean, sd = fits[g, fold] = brute([x for x in whole if x[0] == g and x[1] != fold])
        assert r.mean == pytest.approx(mean, rel=1e-9) and r.sd == pytest.approx(sd, rel=1e-6) and r.beta == pytest.approx(beta, rel=1e-5, abs=1e-7)
    p = df.join(models.where("fold IS NOT NULL"), ["g", "fold"]).select("g", "y", regression.predicted(FEATURES).alias("fit")).where("y IS NOT NULL AND fit IS NOT NULL")
    for r in p.groupBy("g").agg(*regression.fit_metrics(F.col("y"), F.col("fit"), 6, "cv")).collect():
        own = [x for x in whole if x[0] == r.g]
        y = np.array([x[-1] for x in own])
        fit = np.array([fits[r.g, x[1]][0] @ np.append(1, (np.array(x[2:-1]) - fits[r.g, x[1]][1]) / fits[r.g, x[1]][2]) for x in own])
        r2 = 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        assert (r.cv_r2, r.cv_rmse, r.cv_mae, r.cv_adjusted_r2) == pytest.approx((r2, math.sqrt(((y - fit) ** 2).mean()), np.abs(y - fit).mean(), 1 - (1 - r2) * (len(y) - 1) / (len(y) - 7)), abs=2e-5)


def test_too_few_rows_have_no_model(spark):
    data = [r for r in rows(24) if r[0] == 0][:8]
    df = spark.createDataFrame(data, "g int, fold int, a double, b double, c double, d double, e double, f double, y double")
    assert all(r.fold is None for r in regression.fold_models(df, "g", "fold", FEATURES, "y").collect())
    assert regression.fold_models(df.limit(0), "g", "fold", FEATURES, "y").count() == 0


@pytest.mark.parametrize("mixed", [False, True])
def test_bootstrap_against_weighted_sums(spark, mixed):
    rng = random.Random(6)
    data = [(i % 2, f"k{i}", rng.gauss(5, 2), None if i == 9 else rng.gauss(1, 1)) for i in range(90)]
    df = spark.createDataFrame(data, "g int, key string, x double, y double")
    by_parts = {p: {(r.g, r.draw): tuple(r)[2:] for r in regression.bootstrap_moments(df.repartition(p), 40, 7, mixed, block=11).collect()} for p in (1, 5)}
    assert by_parts[1].keys() == by_parts[5].keys() == {(g, d) for g in (0, 1) for d in range(1, 41)}
    for g in (0, 1):
        own = [r for r in data if r[0] == g and r[3] is not None]
        w = regression.poisson_weights([r[1] for r in own], 1, 40, 7, mixed)
        m = np.array([[1, x, y, x * x, y * y, x * y] for _, _, x, y in own])
        for d in range(1, 41):
            assert by_parts[5][g, d] == pytest.approx(tuple(w[d - 1] @ m)) and by_parts[1][g, d] == pytest.approx(by_parts[5][g, d])
    assert regression.bootstrap_moments(df.limit(0), 40).count() == 0


def test_weights_are_poisson(spark):
    w = regression.poisson_weights([f"k{i}" for i in range(400)], 1, 200, 3, True).ravel()
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs((w == 0).mean() - math.exp(-1)) < 0.005 and abs((w == 2).mean() - math.exp(-1) / 2) < 0.005


def test_interval_covers_the_correlation(spark):
    rng = random.Random(12)
    data = [(0, str(i), x, 0.6 * x + 0.8 * rng.gauss(0, 1)) for i in range(250) for x in [rng.gauss(0, 1)]]
    r = regression.correlation_intervals(spark.createDataFrame(data, "g int, key string, x double, y double"), 1_000, mixed=True).first()
    boot = np.random.default_rng(1)
    at = np.array([d[2:] for d in data])
    classic = np.percentile([np.corrcoef(at[boot.integers(0, 250, 250)].T)[0, 1] for _ in range(1_000)], [2.5, 97.5])
    assert r.n_draws == 1_000 and r.r_lower < r.r < r.r_upper and abs(r.r_lower - classic[0]) < 0.03 and abs(r.r_upper - classic[1]) < 0.03

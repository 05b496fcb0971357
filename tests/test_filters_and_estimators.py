"""Filters, estimators of nested draws and gap means against brute force on small panels."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from stationwise.operators import estimators, filters, gaps, sampling

START = dt.date(2024, 1, 1)


def test_sorted_rows():
    rng = np.random.default_rng(3)
    rows = estimators.SortedRows(50, 12)
    drawn = rng.integers(0, 9, (50, 12))
    for n in range(12):
        rows.insert(drawn[:, n])
        want = np.sort(drawn[:, : n + 1], axis=1)
        assert (rows.x[:, : n + 1] == want).all()
        low, high = rows.middle()
        assert np.allclose((low + high) / 2, np.median(drawn[:, : n + 1], axis=1))


def test_estimates_against_each_draw_alone():
    rng = np.random.default_rng(5)
    c = rng.integers(1, 5_000, 17)
    orders = np.array([rng.permutation(17)[:9] for _ in range(40)])
    for n, found in estimators.estimates_by_size(c, orders, (1, 2, 5, 9, 30)):
        x = c[orders[:, :n]] / 100
        log = np.log(x)
        mid = np.median(log, axis=1)
        sigma = 1.4826 * np.median(np.abs(log - mid[:, None]), axis=1)
        want = [x.mean(1), np.median(x, axis=1), np.exp(log.mean(1) + log.var(1, ddof=1) / 2) if n > 1 else np.full(40, np.nan), np.exp(mid + sigma**2 / 2)]
        for a, b in zip(found, want, strict=True):
            assert np.allclose(a, b, equal_nan=True)


def test_median_is_biased_where_values_are_skewed(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(0, d, f"s{i}", int(rng.lognormvariate(8, 0.8))) for d in range(4) for i in range(60)], "city int, date int, sensor_id string, c long")
    got = {(r.n, r.estimator): r for r in estimators.estimator_summary(v, (10,), draws=400, mixed=True).collect()}
    assert set(got) == {(10, n) for n in estimators.NAMES} and all(r.n_days == 4 for r in got.values())
    assert abs(got[10, "mean"].bias_mean) < 4 and got[10, "median"].bias_mean < -12
    assert estimators.estimator_summary(v.limit(0)).count() == 0


def grid_rows(sensors: int, days: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for city in (0, 1):
        for s in range(sensors):
            lost = rng.random() * 0.5
            for d in range(days):
                hours = 0 if rng.random() < lost else rng.randrange(1, 25)
                out.append((str(100 * city + s), city, START + dt.timedelta(d), round(rng.lognormvariate(4, 0.5), 2) if hours else None, hours))
    return out


GRID = "sensor_id string, city int, date date, value double, hours int"


@pytest.mark.parametrize("block", [512, 4])
def test_filters_in_blocks_against_each_filter_alone(spark, block):
    rows = grid_rows(11, 14, 2)
    g = spark.createDataFrame(rows, GRID)
    scores = filters.sensor_scores(g)
    tried = [("all", "", "true"), ("few", "", "p_daily_missing > 4"), ("gap", "", "longest_gap <= 3"), ("none", "", "daily_presence > 2"), ("few again", "", "p_daily_missing >= 5"), ("late", "", "p_late_missing > 2 AND p_record_missing > 1")]
    got = {(r.city, r.f, r.date): r for r in filters.filter_days(g, scores, tried, block).collect()}
    kept = {(r.city, f): set() for r in scores.collect() for f in range(len(tried))}
    for r in scores.selectExpr("city", "sensor_id", *[f"{c} AS f{k}" for k, (_, _, c) in enumerate(tried)]).collect():
        for k in range(len(tried)):
            if r[f"f{k}"]:
                kept[r.city, k].add(r.sensor_id)
    for (city, f), ids in kept.items():
        for d in range(14):
            day = START + dt.timedelta(d)
            own = [x for x in rows if x[1] == city and x[0] in ids and x[2] == day]
            v = [x[3] for x in own if x[3] is not None]
            r = got[city, f, day]
            assert (r.n_kept, r.n_valid) == (len(ids), len(v))
            assert r.mean == (pytest.approx(np.mean(v), abs=1e-8) if v else None)
            assert r.sd == (pytest.approx(np.std(v, ddof=1), abs=1e-6) if len(v) > 1 else None)
            assert r.miss == (pytest.approx(1 - sum(x[4] for x in own) / (24 * len(ids)), abs=1e-8) if ids else None)
    same = {(c, f): frozenset(ids) for (c, f), ids in kept.items()}
    marks = {(r.city, r.f): (r.n_kept, r.mark) for r in got.values()}
    assert all((marks[a] == marks[b]) == (same[a] == same[b]) for a in same for b in same if a[0] == b[0])


def test_scores_against_lists(spark):
    rows = grid_rows(7, 12, 9)
    for r in filters.sensor_scores(spark.createDataFrame(rows, GRID)).collect():
        own = sorted((x for x in rows if x[0] == r.sensor_id and x[1] == r.city), key=lambda x: x[2])
        run = longest = 0
        for x in own:
            run = run + 1 if x[3] is None else 0
            longest = max(longest, run)
        assert r.longest_gap == longest and r.n_sensors == 7 and r.n_days == 12
        assert r.daily_missing == pytest.approx(sum(x[3] is None for x in own) / 12, abs=1e-8)
        assert r.late_missing == pytest.approx(np.mean([1 - x[4] / 24 for x in own[-4:]]), abs=1e-8)


def test_candidates():
    names = [n for n, _, _ in filters.CANDIDATES]
    assert len(names) == len(set(names)) == 173 and names[0] == "baseline"
    assert len({f for _, f, _ in filters.CANDIDATES}) == 17


def test_interval_sums(spark):
    rng = random.Random(4)
    series = [(k, d, None if rng.random() < 0.3 else rng.randrange(100) / 4) for k in (0, 1) for d in range(30)]
    spans = [(k, a, b) for k in (0, 1) for a in range(0, 30, 4) for b in (a, min(29, a + 7), 29)]
    s = spark.createDataFrame(series, "k int, t int, v double")
    i = spark.createDataFrame(spans, "k int, a int, b int")
    found = gaps.interval_sums(i, s, ["k"], "t", "a", "b", "v")
    for r in found.collect():
        v = [x for k, t, x in series if k == r.k and r.a <= t <= r.b and x is not None]
        assert (r._sum, r._n) == (pytest.approx(sum(v)), len(v))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_enumeration_has_a_row_for_each_size(spark, tmp_path, monkeypatch):
    """Where there are too many subsets, draws stand in and say so."""
    rng = random.Random(2)
    rows = [(i, dt.datetime(2024, 1, 1, i % 24), i % 12, "view", float(rng.randrange(100, 900)), None) for i in range(240)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    monkeypatch.setattr(sampling, "MOST_SUBSETS", 100)
    got = {r.n: r for r in sampling.mc_exact_enumeration(spark, folder).collect()}
    assert {n: (r.exact, r.n_subsets) for n, r in got.items()} == {2: (True, 66), 3: (False, 220), 4: (False, 495)}
    monkeypatch.setattr(sampling, "MOST_SUBSETS", 1_000)
    full = {r.n: r for r in sampling.mc_exact_enumeration(spark, folder).collect()}
    assert all(r.exact for r in full.values()) and all(abs(full[n].ape_median - got[n].ape_median) < 0.5 * full[n].ape_median for n in (2, 3, 4))

"""Designs step by step against all choices at once, and permutation counts against permutations one at a time."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from stationwise.operators import designs


@pytest.fixture(scope="module")
def places():
    rng = random.Random(11)
    return [(c, str(100 * c + i), 23.6 + rng.random() * 0.4, 90.3 + rng.random() * 0.4) for c in (1, 2) for i in range(14)] + [(3, "300", 20.0, 80.0), (3, "301", 20.1, 80.0), (3, "302", 20.0, 80.1)]


def test_designs_against_every_choice(spark, places):
    s = spark.createDataFrame(places, "city int, sensor_id string, lat double, lon double")
    c = {r.sensor_id: r.c for r in designs.quadrature_means(s).collect()}
    got: dict = {}
    for r in designs.designs(s.repartition(5), 5).collect():
        got.setdefault((r.city, r.design), {})[r.place] = r
    assert set(got) == {(city, d) for city in (1, 2, 3) for d in ("max_ess", "min_ess", "min_pred_var")}
    for (city, design), rows in got.items():
        own = [p for p in places if p[0] == city]
        lat, lon = np.array([p[2] for p in own]), np.array([p[3] for p in own])
        km = designs.distances(lat, lon)
        target = np.array([c[p[1]] for p in own]) if design == "min_pred_var" else np.ones(len(own))
        score = lambda at: designs.information(lat[at].tolist(), lon[at].tolist(), target[at].tolist())  # noqa: E731, B023
        at = [next(i for i, p in enumerate(own) if p[1] == rows[k].sensor_id) for k in sorted(rows)]
        assert len(at) == min(5, len(own)) == len(set(at))
        np.fill_diagonal(km, np.nan)
        if design == "max_ess":
            assert km[at[0], at[1]] == pytest.approx(np.nanmax(km))
        elif design == "min_ess":
            assert km[at[0], at[1]] == pytest.approx(np.nanmin(km))
        else:
            assert target[at[0]] == pytest.approx(target.max())
        for k in range(1 if design == "min_pred_var" else 2, len(at)):
            each = [score([*at[:k], j]) for j in range(len(own)) if j not in at[:k]]
            assert score(at[: k + 1]) == pytest.approx(min(each) if design == "min_ess" else max(each), rel=1e-6)
        for k in rows:
            assert rows[k].ess == pytest.approx(designs.information(lat[at[:k]].tolist(), lon[at[:k]].tolist(), [1.0] * k), abs=1e-5)


def test_quadrature_means_stand_for_the_hull(spark, places):
    s = spark.createDataFrame(places, "city int, sensor_id string, lat double, lon double")
    for r in designs.quadrature_means(s).where("city < 3").collect():
        assert 0 < r.c < 1
    assert designs.designs(s.limit(0)).count() == 0


def test_permutation_counts(spark):
    rng = random.Random(7)
    rows = [(c, f"d{i:02d}", rng.gauss(0, 1) + 0.1 * i * c, rng.random(), float(i), float(rng.randrange(9)), float(rng.randrange(9))) for c in (0, 1) for i in range(12)] + [(5, "few", 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "city int, key string, y double, a double, b double, ry double, ra double")
    by = {block: {r.city: r for r in designs.permutation_counts(df, 60, block).collect()} for block in (7, 60)}
    assert by[7] == by[60] and set(by[7]) == {0, 1}
    for c, r in by[7].items():
        own = sorted(x for x in rows if x[0] == c)
        z = lambda v: (np.array(v) - np.mean(v)) / np.std(v)
        x = np.column_stack([z([o[3] for o in own]), z([o[4] for o in own])])
        stats = lambda at: [*np.linalg.lstsq(x, z([own[k][2] for k in at]), rcond=None)[0], np.corrcoef([own[k][5] for k in at], [o[6] for o in own])[0, 1]]  # noqa: E731, B023
        true, reached = np.array(stats(range(12))), np.zeros(3, int)
        for p in range(1, 61):
            order = sorted(range(12), key=lambda k: hashlib.md5(f"{p}|{c}|{own[k][1]}".encode()).hexdigest())  # noqa: B023
            place = np.empty(12, int)
            place[order] = np.arange(12)
            reached += np.abs(stats(place)) >= np.abs(true) - 1e-9
        assert r.n == 12 and r.drawn == 60 and r.own == pytest.approx(true.tolist()) and list(r.reached) == reached.tolist()

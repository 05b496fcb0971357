"""Links and distances of sensors that share places, against all pairs of sensors."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from stationwise.operators import spatial

SENSORS = "city int, sensor_id string, lat double, lon double"


def network(spark, n=60, spots=7):
    rng = random.Random(8)
    at = [(23.7 + rng.random() / 9, 90.4 + rng.random() / 9) for _ in range(spots)]
    sites = [(i % 2, str(i), *at[i % spots]) for i in range(n)]
    days = [(c, i, dt.date(2024, 1, 1 + k), rng.uniform(1, 90)) for c, i, _, _ in sites for k in range(4) if rng.random() < 0.7]
    return spark.createDataFrame(sites, SENSORS), spark.createDataFrame(days, "city int, sensor_id string, date date, value double"), days


def test_moran_sums_by_places(spark):
    s, d, days = network(spark)
    links = [(r.a, r.b) for r in spatial.within(s, 5.0).collect()]
    got = {(r.city, r.date): r for r in spatial.moran_sums(d, s, 5.0).collect()}
    assert len(got) == 8 and len(links) > 400
    for (city, date), r in got.items():
        v = {i: x for c, i, t, x in days if (c, t) == (city, date)}
        mean = sum(v.values()) / len(v)
        z = {i: x - mean for i, x in v.items()}
        k = {a: [b for x, b in links if x == a and b in z] for a in z}
        assert (r.n, r.s0, r.k2) == (len(z), sum(map(len, k.values())), sum(len(x) ** 2 for x in k.values()))
        assert (r.s2, r.s4) == (pytest.approx(sum(x**2 for x in z.values())), pytest.approx(sum(x**4 for x in z.values())))
        assert r.num == pytest.approx(sum(z[a] * z[b] for a in z for b in k[a]))


def every_pair(spark, s):
    rows = s.collect()
    at = spark.createDataFrame([(x.city, x.sensor_id, y.sensor_id, x.lat, x.lon, y.lat, y.lon) for x in rows for y in rows if x.city == y.city and int(x.sensor_id) < int(y.sensor_id)], "city int, a string, b string, lat double, lon double, lat2 double, lon2 double")
    return at.select("city", "a", "b", spatial.haversine_km("lat", "lon", "lat2", "lon2").alias("km"))


def test_pairs_and_distances_by_places(spark):
    s, _, _ = network(spark)
    want = sorted(map(tuple, every_pair(spark, s).collect()))
    assert sorted(map(tuple, spatial.pairs(s).collect())) == want
    at = spatial.place_pairs(s)  # 14 places: no more rows meet, however many sensors share them
    assert at.count() == 2 * 7 * 8 // 2
    counted = {}
    for city, _, _, km in want:
        counted[city, km] = counted.get((city, km), 0) + 1
    got = spatial.distances(s).groupBy("city", "km").sum("n").collect()
    assert {(r.city, r.km): r[2] for r in got} == counted


def test_links_by_places(spark):
    s, _, _ = network(spark)
    want = {(r.a, r.b, r.km) for r in every_pair(spark, s).collect() if 0 < r.km <= 5}
    assert {(r.a, r.b, r.km) for r in spatial.within(s, 5.0).collect()} == want | {(b, a, km) for a, b, km in want}
    assert spatial.near_places(spatial.places(s), 5.0).count() <= 2 * 7 * 6 < len(want)


def test_medians_of_pairs_by_counting(spark):
    s, d, _ = network(spark, 70, 70)
    want = sorted(map(tuple, spatial.pair_medians(d, s, 10, least=2).collect()))
    assert sorted(map(tuple, spatial.pair_medians(d, s, 10, 0, least=2).collect())) == want and len(want) >= 6
    flat = d.withColumn("value", spatial.F.lit(5.0))  # no correlations, and all differences 0
    want = sorted(map(tuple, spatial.pair_medians(flat, s, 10).collect()))
    assert sorted(map(tuple, spatial.pair_medians(flat, s, 10, 0).collect())) == want and want[0][3:] == (None, 0.0, 0.0)

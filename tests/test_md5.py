"""Digests of many texts at once, and Moran's I under permutations when sensors share places."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import numpy as np

from stationwise.functions.md5 import Texts
from stationwise.operators import inference


def test_digests():
    texts = ["", "a", "ä|", *map(str, range(40_000)), "x" * 54, "x" * 55, "x" * 56, "y" * 200]
    for prefix in ("", "7|2024-01-03|", "p" * 20, "p" * 60):
        high, low = Texts(texts).digests(prefix)
        want = np.frombuffer(b"".join(hashlib.md5((prefix + t).encode()).digest() for t in texts), ">u8").reshape(-1, 2)
        assert (high == want[:, 0]).all() and (low == want[:, 1]).all()
        part = Texts(texts).digests(prefix, 5, 33_000)
        assert (part[0] == high[5:33_000]).all() and (part[1] == low[5:33_000]).all()


def test_permutations_of_sensors_that_share_places(spark):
    rng = random.Random(6)
    spots = [(23.7 + k / 90, 90.4 + k % 3 / 90) for k in range(9)]
    day = dt.date(2024, 1, 2)
    rows = [(1, day, str(i), rng.uniform(1, 90), *spots[i % 9]) for i in range(40)] + [(2, day, str(i), 5.0, *spots[0]) for i in range(40, 44)]
    days = spark.createDataFrame(rows, "city int, date date, sensor_id string, value double, lat double, lon double")
    (got,) = inference.permuted_moran(days, 39, 3.0).collect()
    own = sorted((r for r in rows if r[0] == 1), key=lambda r: r[2])
    z = np.array([r[3] for r in own])
    z = z - z.mean()
    lat, lon = np.radians([r[4] for r in own]), np.radians([r[5] for r in own])
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(h))
    linked = (km > 0) & (km <= 3)
    found = []
    for perm in range(40):
        order = sorted(range(40), key=lambda k: (hashlib.md5(f"{perm}|{day}|{own[k][2]}".encode()).hexdigest() if perm else "", own[k][2]))
        v = np.empty(40)
        v[order] = z
        found.append(round(40 * (v @ linked @ v) / linked.sum() / (z @ z), 9))
    assert (got.city, got.n_permutations, got.moran) == (1, 39, round(found[0], 6)) and 0 < linked.sum() < 1_500
    assert got.p_upper == round((1 + sum(x >= found[0] for x in found[1:])) / 40, 6)

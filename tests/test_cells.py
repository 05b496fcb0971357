"""Cell covers and nearest neighbours against brute force over all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stationwise.operators import cells

EDGES = "poly int, x1 double, y1 double, x2 double, y2 double"


def polygon(rng: random.Random, corners: int, x: float, y: float, size: float) -> list[tuple[float, float]]:
    turns = sorted(rng.random() * 2 * math.pi for _ in range(corners))
    return [(x + size * rng.uniform(0.15, 1) * math.cos(t), y + size * rng.uniform(0.15, 1) * math.sin(t)) for t in turns]


def inside(px: float, py: float, ring: list) -> bool:
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.fixture(scope="module")
def rings():
    rng = random.Random(2)
    square = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]  # its edges lie on cell borders
    return [square, polygon(rng, 7, 1.5, 1.2, 1.4), polygon(rng, 40, -0.3, 0.4, 0.9), polygon(rng, 3, 0.05, 0.05, 0.02), [(0.0, 0.0), (3.0, 0.001), (3.0, 0.002)]]


@pytest.fixture(scope="module")
def edges(spark, rings):
    return spark.createDataFrame([(k, *a, *b) for k, r in enumerate(rings) for a, b in zip(r, r[1:] + r[:1])], EDGES)


@pytest.mark.parametrize("step", [0.25, 0.07])
def test_cover_and_points(spark, rings, edges, step):
    rng = random.Random(3)
    points = [(k, rng.uniform(-1.5, 3.2), rng.uniform(-1.2, 2.8)) for k in range(1_500)] + [(2_000, 1.0, 1.0), (2_001, 2.0, 1.5), (2_002, 1.0, 1.5), (2_003, None, 1.0)]
    df = spark.createDataFrame(points, "k long, x double, y double")
    got = {(r.poly, r.k) for r in cells.points_in(df, edges, "x", "y", "k", step).collect()}
    assert got == {(n, k) for n, ring in enumerate(rings) for k, x, y in points if x is not None and inside(x, y, ring)}
    cover = cells.cell_cover(edges, step).collect()
    assert len(cover) == len({(r.poly, r.i, r.j) for r in cover})
    for r in cover:  # all of an inside cell is inside
        if r.kind == "inside":
            assert all(inside((r.i + a) * step, (r.j + b) * step, rings[r.poly]) for a in (0.01, 0.5, 0.99) for b in (0.01, 0.5, 0.99))


def test_only_border_cells_meet_edges(edges):
    kinds = {r.kind: r.n for r in cells.cell_cover(edges.where("poly = 0"), 0.05).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds["inside"] > 300 and kinds["border"] <= 4 * 2 * 20


def test_quadrature_points(rings, edges):
    got = {(r.poly, r.gx, r.gy) for r in cells.quadrature_points(edges, 0.2, 4).collect()}
    want = {(n, i, j) for n, ring in enumerate(rings) for i in range(-40, 80) for j in range(-40, 80) if inside((i + 0.5) * 0.05, (j + 0.5) * 0.05, ring)}
    assert got == want


def km(a, b) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def places(kind: str) -> list[tuple[float, float]]:
    rng = random.Random(kind)
    if kind == "clustered":  # a dense place, a second one near it, lone ones far away, and twins
        dense = [(23.7 + rng.gauss(0, 1e-4), 90.4 + rng.gauss(0, 1e-4)) for _ in range(120)] + [(23.71 + rng.gauss(0, 1e-5), 90.41 + rng.gauss(0, 1e-5)) for _ in range(40)]
        return dense + [(20.0, 85.0), (26.5, 95.0), (23.7, 91.9)] + [dense[0]] * 3
    if kind == "wide":  # from the equator to far north
        return [(rng.uniform(-5, 68), rng.uniform(-120, 120)) for _ in range(150)]
    return [(41.6 + rng.random() * 0.5, -88 + rng.random() * 0.5) for _ in range(200)]


@pytest.mark.parametrize("kind", ["clustered", "wide", "even"])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_neighbours(spark, kind, k):
    at = places(kind)
    rows = [(0, str(i), *p) for i, p in enumerate(at)] + [(1, "a", 10.0, 10.0), (1, "b", 11.0, 10.0), (2, "alone", 1.0, 1.0), (1, "lost", None, 1.0)]
    s = spark.createDataFrame(rows, "city int, id string, lat double, lon double")
    found = cells.k_nearest(s.withColumnRenamed("id", "a"), s.withColumnRenamed("id", "b"), k, "city")
    got = {(r.city, r.a, r.place): (r.b, round(r.km, 7)) for r in found.collect()}
    want = {(1, "a", 1): ("b", round(km((10, 10), (11, 10)), 7)), (1, "b", 1): ("a", round(km((10, 10), (11, 10)), 7))}
    for i, p in enumerate(at):
        near = sorted((round(km(p, q), 9), j) for j, q in enumerate(at) if j != i)[:k]
        want |= {(0, str(i), n + 1): (str(j), round(d, 7)) for n, (d, j) in enumerate(near)}
    assert {x: b for x, (b, _) in got.items()} == {x: b for x, (b, _) in want.items()}
    assert all(abs(got[x][1] - want[x][1]) < 1e-6 for x in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_nearest_targets_of_other_points(spark):
    p = spark.createDataFrame([(0, "x", 0.0, 0.0), (0, "far", 30.0, 40.0)], "g int, a string, lat double, lon double")
    t = spark.createDataFrame([(0, "1", 0.1, 0.0), (0, "2", 0.0, 0.05), (0, "3", 0.001, 0.05)], "g int, b string, lat double, lon double")
    assert {(r.a, r.b, r.place) for r in cells.k_nearest(p, t, 2, "g").collect()} == {("x", "2", 1), ("x", "3", 2), ("far", "1", 1), ("far", "3", 2)}
    assert cells.k_nearest(p, t.limit(0), 2, "g").count() == 0 and cells.k_nearest(p.limit(0), t, 2, "g").count() == 0

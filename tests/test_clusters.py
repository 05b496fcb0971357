"""k-means of all starts and k at once against numpy and Spark's own, silhouettes against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from stationwise.operators import clusters


def points(seed: int, n: int, g: str, middles: int) -> list[tuple]:
    rng = random.Random(seed)
    at = [[rng.uniform(-5, 5) for _ in range(3)] for _ in range(middles)]
    return [(g, f"{g}{i}", [c + rng.gauss(0, 0.4) for c in at[i % middles]]) for i in range(n)]


SCHEMA = "g string, id string, x array<double>"


@pytest.fixture(scope="module")
def data():
    return points(1, 90, "a", 3) + points(2, 140, "b", 5) + [("c", "c0", [0.0, 0.0, 0.0]), ("c", "c1", [1.0, 0.0, 0.0]), ("c", "c2", [1.0, 0.0, 0.0])]


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        same[i] = False
        a = far[i, same].mean() if same.any() else 0.0
        b = min((far[i, labels == c].mean() for c in set(labels.tolist()) - {own}), default=0.0)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@pytest.fixture(scope="module")
def fitted(spark, data):
    rows = spark.createDataFrame(data, SCHEMA).repartition(5)
    scores, found = clusters.cluster_scores(rows, range(2, 6), starts=20)
    return rows, {(r.g, r.k): r for r in scores.collect()}, found


def test_runs_settle(data, fitted):
    """Each row lies nearest its own centre, which is the mean of its rows; no k has more clusters than rows."""
    rows, scores, found = fitted
    assert set(found) == {(g, k) for g in "ab" for k in range(2, 6)} | {("c", 2)} == set(scores)
    for (g, k), f in found.items():
        x = np.array([r[2] for r in data if r[0] == g])
        d = ((x[:, None] - f.centres[None]) ** 2).sum(2)
        label = d.argmin(1)
        assert np.bincount(label, minlength=k).tolist() == f.counts.tolist() and f.inertia == pytest.approx(d.min(1).sum(), abs=1e-9)
        assert all(np.allclose(x[label == c].mean(0), f.centres[c], atol=1e-7) for c in range(k) if (label == c).any())
        assert scores[g, k].silhouette == pytest.approx(silhouette(x, label), abs=1e-9)


def test_best_k_is_the_number_of_groups(fitted):
    assert {g: k for (g, k), r in fitted[1].items() if r.best} == {"a": 3, "b": 5, "c": 2}


def test_inertia_is_never_above_sparks_own(spark, data, fitted):
    for g in "ab":
        df = spark.createDataFrame([r for r in data if r[0] == g], SCHEMA).select(array_to_vector("x").alias("features"))
        for k in range(2, 6):
            assert fitted[2][g, k].inertia <= KMeans(k=k, seed=k, maxIter=100).fit(df).summary.trainingCost * (1 + 1e-9)


def test_partitions_change_nothing(spark, data, fitted):
    again = clusters.k_means(spark.createDataFrame(data, SCHEMA).repartition(2), range(2, 6), starts=20)
    for key, f in fitted[2].items():
        assert np.allclose(again[key].centres, f.centres) and again[key].inertia == pytest.approx(f.inertia)


def test_silhouettes_in_small_blocks(data, fitted):
    rows, scores, found = fitted
    got = {(r.g, r.k): r.silhouette for r in clusters.silhouettes(rows, found, block=16).collect()}
    assert got == {key: pytest.approx(r.silhouette, abs=1e-9) for key, r in scores.items()}


def test_fewer_different_rows_than_centres(spark):
    """Equal rows leave centres empty; they are seeded anew and nothing fails."""
    rows = spark.createDataFrame([("e", f"e{i}", [float(i % 2), 1.0]) for i in range(9)], SCHEMA)
    found = clusters.k_means(rows, range(2, 5), starts=3)
    assert all(f.inertia == pytest.approx(0, abs=1e-9) and f.counts.sum() == 9 for f in found.values())
    assert clusters.k_means(rows.limit(0), range(2, 4), starts=3) == {}


def test_standardised(spark):
    df = spark.createDataFrame([(0, "a", 1.0, 5.0), (0, "b", 3.0, 5.0), (0, "c", None, 5.0), (0, "d", float("nan"), 1.0)], "city int, id string, p double, q double")
    assert {r.id: list(r.x) for r in clusters.standardised(df, "city", "id", ["p", "q"]).collect()} == {"a": [-1.0, 0.0], "b": [1.0, 0.0]}

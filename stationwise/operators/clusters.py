"""k-means with many starts and every k at once, and the silhouettes of what it finds.

All centres of all starts travel to the tasks as one matrix, whose size the parameters set.  A task turns its rows into sums
for each centre, the inertia of each start and its farthest row; these are added up by group and k, and the driver moves the
centres.  A centre without rows goes to the row that is farthest from its own centre.  Starts are chosen by k-means++: the
row with the least ``-ln(u) / distance`` is drawn in proportion to its squared distance, and ``u`` is a hash of row, start and step, so
the result does not depend on how rows are dealt to tasks.  A start's first k rows begin its run with k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.functions.exprs import ratio
from stationwise.operators.gaps import missing_runs
from stationwise.operators.panel import share, six
from stationwise.operators.sampling import SEED, _mix
from stationwise.operators.spatial import neighbours
from stationwise.plans.registry import query
from stationwise.sources.panel import daily, grid, readings, sites
from stationwise.sources.scratch import written

STARTS, MOST_K, MOST_ITERATIONS, TOLERANCE = 40, 8, 300, 1e-8
#: Groups whose centres the driver may hold; rows that a task looks at together; rows of a block of silhouettes.
MOST_GROUPS, ROWS, BLOCK = 1_000, 2_048, 1_024


def standardised(df: DataFrame, group: str, key: str, features: list[str]) -> DataFrame:
    """``(g, id, x)``: the features over their group's means and deviations (0 where a feature does not vary); rows that lack one go."""
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in features))
    stats = whole.groupBy(F.col(group).cast("string").alias("g")).agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [F.when(F.col(f"{c}_s") > 1e-12, (F.col(c) - F.col(f"{c}_m")) / F.nullif(F.col(f"{c}_s"), F.lit(0.0))).otherwise(0.0) for c in features]
    return whole.withColumn("g", F.col(group).cast("string")).join(stats, "g").select("g", F.col(key).cast("string").alias("id"), F.array(*z).alias("x"))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """``(group, hashes of ids, features)`` of at most ``ROWS`` rows of a group at a time."""
    for batch in batches:
        groups, hashes = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy().view(np.uint64)
        x = batch.column(2).flatten().to_numpy().reshape(len(groups), -1)
        for g in dict.fromkeys(groups.tolist()):
            own = np.flatnonzero(groups == g)
            for k in range(0, len(own), ROWS):
                yield g, hashes[own[k : k + ROWS]], x[own[k : k + ROWS]]


def _gathered(rows: DataFrame, part: Callable[[dict, str, np.ndarray, np.ndarray], None], add: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> dict[tuple[str, int], np.ndarray]:
    """What ``part(held, g, hashes, x)`` makes of all rows in ``held[g, k]``, a matrix for each task, brought together by ``add``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for g, hashes, x in _arrays(batches):
            part(held, g, hashes, x)
        if held:
            yield pack(held)

    def pack(held: dict) -> pa.RecordBatch:
        shapes = [list(v.shape) for v in held.values()]
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in held], pa.string()), pa.array([k for _, k in held], pa.int32()), pa.array(shapes, pa.list_(pa.int32())), pa.array([np.ascontiguousarray(v).tobytes() for v in held.values()], pa.binary())], ["g", "k", "shape", "m"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                m = np.frombuffer(r["m"]).reshape(r["shape"])
                held[r["g"], r["k"]] = add(r["k"], held[r["g"], r["k"]], m) if (r["g"], r["k"]) in held else m
        if held:
            yield pack(held)

    schema = "g string, k int, shape array<int>, m binary"
    parts = rows.select("g", F.xxhash64("id").alias("h"), "x").mapInArrow(work, schema)
    found = parts.repartition("g", "k").mapInArrow(merge, schema).collect()  # a matrix for each group and k, of a size that the parameters set
    return {(r.g, r.k): np.frombuffer(r.m).reshape(r["shape"]) for r in found}


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    return np.maximum(d, 0)


def _least(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each start, the row ``(key, features)`` with the lesser key."""
    return np.where(a[..., :1] <= b[..., :1], a, b)


def seeded(rows: DataFrame, starts: int, most: int, seed: int = SEED) -> dict[str, np.ndarray]:
    """``{g: (starts, most, d)}``: k-means++ starts of each group; where all rows lie on centres, any row."""
    chosen: dict[str, list[np.ndarray]] = {}
    for step in range(most):
        salt = _mix(np.arange(starts, dtype=np.uint64) + _mix(np.array([seed * 1_000 + step], np.uint64)))
        so_far = {g: np.stack(c, 1) for g, c in chosen.items()}

        def part(held: dict, g: str, hashes: np.ndarray, x: np.ndarray, salt=salt, so_far=so_far) -> None:
            u = (_mix(hashes[:, None] ^ salt[None, :]) >> np.uint64(11)).astype(float) + 0.5
            key = -np.log(u / 2.0**53)
            near = np.stack([_distances(x, c).min(1) for c in so_far[g]], 1) if g in so_far else np.ones_like(key)
            with np.errstate(divide="ignore"):
                keys = np.stack([np.where(near > 0, key / near, np.inf), key])  # by distance, and by chance
            for k in (0, 1):
                at = keys[k].argmin(0)
                best = np.column_stack([keys[k][at, np.arange(starts)], x[at]])
                held[g, k] = _least(k, held[g, k], best) if (g, k) in held else best

        found = _gathered(rows, part, _least)
        if len({g for g, _ in found}) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups")
        for g in {g for g, _ in found}:
            by_distance, by_chance = found[g, 0], found[g, 1]
            chosen.setdefault(g, []).append(np.where(np.isfinite(by_distance[:, :1]), by_distance, by_chance)[:, 1:])
    return {g: np.stack(c, 1) for g, c in chosen.items()}


@dataclass
class Found:
    """The best start of a group and k."""

    centres: np.ndarray
    counts: np.ndarray
    inertia: float
    iterations: int


def k_means(rows: DataFrame, ks: range = range(2, MOST_K + 1), starts: int = STARTS, seed: int = SEED, most_iterations: int = MOST_ITERATIONS) -> dict[tuple[str, int], Found]:
    """The run of least inertia for each group and each k below its number of rows; ``rows(g, id, x)`` are read once for each step."""
    sizes = {r.g: r["count"] for r in rows.groupBy("g").count().limit(MOST_GROUPS + 1).collect()}
    began = seeded(rows, starts, max(ks), seed)
    centres = {(g, k): c[:, :k].copy() for g, c in began.items() for k in ks if k < sizes[g]}
    taken = dict.fromkeys(centres, 0)
    moving = {key: np.ones(starts, bool) for key in centres}
    for _ in range(most_iterations):
        on = {key: c[moving[key]] for key, c in centres.items() if moving[key].any()}
        if not on:
            break
        found = _gathered(rows, _sums_of(on), _added)
        for key, c in on.items():
            m, k, d = found[key], key[1], c.shape[2]
            counts, sums, far = m[:, :k], m[:, k : k + k * d].reshape(-1, k, d), m[:, k + k * d + 2 :]
            new = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], far[:, None, :])
            shift = np.sqrt(((new - c) ** 2).sum(2)).max(1)
            centres[key][moving[key]] = new
            moving[key][moving[key]] = shift >= TOLERANCE
            taken[key] += 1
    last = _gathered(rows, _sums_of(centres), _added) if centres else {}
    out = {}
    for key, m in last.items():
        k, d = key[1], centres[key].shape[2]
        best = int(m[:, k + k * d].argmin())
        order = np.lexsort(centres[key][best].T[::-1])  # clusters are numbered by their centres
        out[key] = Found(centres[key][best][order], m[best, :k][order], float(m[best, k + k * d]), taken[key])
    return out


def _sums_of(centres: dict[tuple[str, int], np.ndarray]) -> Callable:
    """For each start: rows of each centre, their sums, the inertia, and the farthest row after its distance."""

    def part(held: dict, g: str, hashes: np.ndarray, x: np.ndarray) -> None:
        for (own, k), c in centres.items():
            if own != g:
                continue
            s, _, d = c.shape
            far = _distances(x, c.reshape(s * k, d)).reshape(len(x), s, k)
            label, near = far.argmin(2), far.min(2)
            hit = (label[:, :, None] == np.arange(k)).reshape(len(x), s * k).astype(float)
            most = near.argmax(0)
            m = np.column_stack([hit.sum(0).reshape(s, k), (hit.T @ x).reshape(s, k * d), near.sum(0), near[most, np.arange(s)], x[most]])
            held[g, k] = _added(k, held[g, k], m) if (g, k) in held else m

    return part


def _added(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two tasks' sums; the last columns hold the farthest row of either, behind its distance."""
    d = (a.shape[1] - k - 2) // (k + 1)
    cut = k + k * d + 1
    return np.column_stack([a[:, :cut] + b[:, :cut], np.where(a[:, cut : cut + 1] >= b[:, cut : cut + 1], a[:, cut:], b[:, cut:])])


def labelled(rows: DataFrame, found: dict[tuple[str, int], Found]) -> DataFrame:
    """``rows`` with ``labels``, a map from k to the row's cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = np.array([x])
                out.append([(k, int(_distances(at, f.centres)[0].argmin())) for (own, k), f in found.items() if own == g])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.map_(pa.int32(), pa.int32()))], ["g", "id", "x", "labels"])

    return rows.select("g", "id", "x").mapInArrow(run, "g string, id string, x array<double>, labels map<int, int>")


def silhouettes(rows: DataFrame, found: dict[tuple[str, int], Found], block: int = BLOCK) -> DataFrame:
    """``(g, k, silhouette)``: the mean over all rows, each against all rows of its group, for every k at once.

    A task holds a block of a group's rows and their sums of distances to each cluster of each k, and the group's rows stream
    past it; a row alone in its cluster has a distance of 0 to it.
    """
    sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = dealt.select("g", F.col("block").alias("i"), F.lit(0).alias("side"), "id", "x")
    others = dealt.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(1).alias("side"), "id", "x")
    ks = {g: [k for (own_, k) in found if own_ == g] for g in {g for g, _ in found}}

    def labels(g: str, x: np.ndarray) -> list[np.ndarray]:
        return [_distances(x, found[g, k].centres).argmin(1) for k in ks.get(g, ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, at, sums = None, [], None, []

        def close() -> pa.RecordBatch | None:
            if at is None or not ks.get(key[0]):
                return None
            g, out = key[0], []
            for k, label, total in zip(ks[g], labels(g, at), sums, strict=True):
                n, r = found[g, k].counts, np.arange(len(at))
                mine = np.where(n[label] > 1, total[r, label] / np.maximum(n[label] - 1, 1), 0.0)
                mean = total / np.maximum(n, 1)
                mean[:, n == 0] = np.inf
                mean[r, label] = np.inf
                b = mean.min(1)
                b = np.where(np.isfinite(b), b, 0.0)
                top = np.maximum(mine, b)
                out.append((g, k, float(np.divide(b - mine, top, out=np.zeros(len(at)), where=top > 0).sum()), len(at)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.float64(), pa.int64()), strict=True)], ["g", "k", "s", "n"])

        def start() -> None:
            nonlocal at, sums
            at = np.array(held)
            sums = [np.zeros((len(at), k)) for k in ks.get(key[0], ())]
            held.clear()

        for batch in batches:
            x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            g, i, side = (batch.column(k).to_pylist() for k in range(3))
            k = 0
            while k < len(g):
                if (g[k], i[k]) != key:
                    if key is not None and (found_ := close()) is not None:
                        yield found_
                    key, held, at = (g[k], i[k]), [], None
                end = k
                while end < len(g) and end < k + ROWS and (g[end], i[end]) == key and side[end] == side[k]:
                    end += 1
                if side[k] == 0:
                    held += x[k:end].tolist()
                else:
                    if at is None:
                        start()
                    far = np.sqrt(_exact(at, x[k:end]))
                    for s, label, n in zip(sums, labels(key[0], x[k:end]), ks.get(key[0], ()), strict=True):
                        s += far @ (label[:, None] == np.arange(n)).astype(float)
                k = end
        if key is not None and (found_ := close()) is not None:
            yield found_

    both = own.unionByName(others).repartition("g", "i").sortWithinPartitions("g", "i", "side").select("g", "i", "side", "x")
    return both.mapInArrow(run, "g string, k int, s double, n long").groupBy("g", "k").agg(ratio(F.sum("s"), F.sum("n")).alias("silhouette"))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by differences: 0 for equal rows."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


def cluster_scores(rows: DataFrame, ks: range = range(2, MOST_K + 1), starts: int = STARTS, seed: int = SEED) -> tuple[DataFrame, dict[tuple[str, int], Found]]:
    """``(g, k, n_rows, inertia, silhouette, iterations, best)`` and what was found; ``best`` has the largest silhouette, then the least k."""
    spark = rows.sparkSession
    rows = written(rows, "cluster-rows")
    found = k_means(rows, ks, starts, seed)
    table = [(g, k, int(f.counts.sum()), f.inertia, f.iterations) for (g, k), f in sorted(found.items())]
    scores = spark.createDataFrame(table, "g string, k int, n_rows long, inertia double, iterations int").join(silhouettes(rows, found), ["g", "k"], "left")
    best = F.row_number().over(Window.partitionBy("g").orderBy(F.desc(F.round("silhouette", 9)), "k")) == 1
    return scores.withColumn("best", best), found


DAY_FEATURES, SENSOR_FEATURES = ["mean", "sd", "missing"], ["lat", "lon", "mean", "sd", "uptime", "log_gap", "log_near"]


def _scores_of(rows: DataFrame) -> DataFrame:
    scores, _ = cluster_scores(rows)
    return scores.withColumns({"inertia": six("inertia"), "silhouette": six("silhouette")})


def day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(daily(readings(spark, sf_dir)))
    return g.groupBy("city", "date").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (1 - share(F.col("value").isNotNull())).alias("missing"))


def sensor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    s, g = sites(r), grid(daily(r))
    u = g.groupBy("city", "sensor_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), share(F.col("value").isNotNull()).alias("uptime"))
    gap = missing_runs(g).groupBy("sensor_id").agg(F.max("days").alias("gap"))
    near = neighbours(s, 1).select(F.col("a").alias("sensor_id"), F.log1p("km").alias("log_near"))
    u = u.join(s.select("sensor_id", "lat", "lon"), "sensor_id").join(near, "sensor_id").join(gap, "sensor_id", "left")
    return u.withColumn("log_gap", F.log1p(F.coalesce("gap", F.lit(0))))


@query()
def day_cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each k for the days of all cities together and of each city: the least inertia of 40 starts, and its silhouette."""
    d = day_features(spark, sf_dir).withColumn("id", F.concat_ws("|", F.col("city").cast("string"), F.col("date").cast("string")))
    both = d.withColumn("scope", F.explode(F.array(F.lit("all"), F.concat(F.lit("city "), F.col("city").cast("string")))))
    return _scores_of(standardised(both, "scope", "id", DAY_FEATURES))


@query()
def sensor_cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each k for the sensors of each city, by place, level, spread, uptime, longest gap and nearest neighbour."""
    return _scores_of(standardised(sensor_features(spark, sf_dir), "city", "sensor_id", SENSOR_FEATURES))


@query()
def sensor_cluster_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of each city's best k: their sensors, and the means of what these were grouped by."""
    u = written(sensor_features(spark, sf_dir), "sensor-features")
    rows = standardised(u, "city", "sensor_id", SENSOR_FEATURES)
    scores, found = cluster_scores(rows)
    best = scores.where("best").select("g", "k")
    at = labelled(rows, found).join(best, "g").select(F.col("g"), F.col("id").alias("sensor_id"), "k", F.expr("labels[k]").alias("cluster"))
    both = u.join(at, "sensor_id").groupBy(F.col("g").alias("city"), "k", "cluster")
    return both.agg(F.count(F.lit(1)).alias("n"), *[six(F.avg(c)).alias(c) for c in SENSOR_FEATURES])

"""Every registered query of the network analytics against its SQL, at the smallest scale, and the traps around it."""

from __future__ import annotations

import datetime as dt
import json
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationwise import catalog
from stationwise.functions import exprs
from stationwise.operators import gaps, spatial
from stationwise.sources import panel
from stationwise.streaming import panel as stream

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(frame):
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        numeric = out[c].dtype.kind in "fiu" or str(out[c].dtype) in ("Int64", "Int32", "Float64")
        out[c] = out[c].astype("float64") if numeric else out[c].astype(str).str.replace(" 00:00:00", "")
    names = sorted(out.columns, key=lambda c: (out[c].dtype.kind == "f", c))
    return out.sort_values(names, key=lambda c: c.round(3) if c.dtype.kind == "f" else c).reset_index(drop=True)


#: With fifteen sensors, no two lie within the radius.
EMPTY = {"distance_band_links", "moran_daily", "moran_permutation", "moran_significance", "representative_days"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got) or name in EMPTY
    if name in catalog.ORACLES:
        want = oracle.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
        if len(got):
            pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, atol=2e-4, rtol=1e-6)


def test_subsets_against_enumeration(spark):
    """Either way of ordering draws every subset alike: errors come near those of all subsets, and are reproducible."""
    from itertools import combinations

    import numpy as np

    from stationwise.operators import sampling

    rng = random.Random(5)
    c = [rng.randrange(500, 9_000) for _ in range(12)]
    df = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(c)], "sensor_id string, c long")
    ref = np.mean(c)
    for mixed in (False, True):
        rows = {r.n: r for r in sampling.simulate_one(df, sampling.summary, sampling._SUMMARY, 4_000, 30, block=700, mixed=mixed).collect()}
        again = sampling.simulate(df.withColumn("k", F.lit(1)), ("k",), sampling.summary, sampling._SUMMARY, 4_000, 30, mixed=mixed).collect()
        assert {tuple(r)[1:] for r in again} == {tuple(r) for r in rows.values()} and set(rows) == set(range(2, 13))
        for n in (2, 3, 6):
            exact = [100 * abs(np.mean(s) - ref) / ref for s in combinations(c, n)]
            assert rows[n].n_draws == 4_000 and abs(rows[n].ape_median - np.median(exact)) < 0.08 * np.median(exact) and rows[n].ape_max <= max(exact) + 1e-6
            assert abs(rows[n].rse_normal_pct - rows[n].rse_empirical_pct) < 0.05 * rows[n].rse_normal_pct
        assert rows[12].ape_max == 0
    empty = df.limit(0)
    assert sampling.simulate_one(empty, sampling.summary, sampling._SUMMARY).count() == 0 and sampling.simulate(empty.withColumn("k", F.lit(1)), ("k",), sampling.summary, sampling._SUMMARY).count() == 0


def test_shapiro_wilk():
    import numpy as np

    from stationwise.operators.designs import shapiro_wilk

    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))  # a published example
    assert abs(w - 0.78881) < 2e-4 and abs(p - 0.006704) < 2e-4
    rng = np.random.default_rng(3)
    for n in (3, 5, 9, 40, 400):
        ps = [shapiro_wilk(rng.standard_normal(n))[1] for _ in range(200)]
        assert 0.35 < np.mean(ps) < 0.65 and all(0 <= x <= 1 for x in ps)
    assert shapiro_wilk(rng.exponential(size=100))[1] < 1e-3 and shapiro_wilk(np.ones(9)) is None


def test_permutation_test_and_designs():
    import numpy as np

    from stationwise.operators import designs

    rng = np.random.default_rng(4)
    x = rng.standard_normal((80, 2))
    beta, p = designs.permuted(2 * x[:, 0] + 0.1 * rng.standard_normal(80), x, 199, 1)
    assert beta[0] > 0.9 and p[0] == 1 / 200 and p[1] > 0.02
    cov = np.exp(-designs.distances(23.7 + rng.random(12) / 3, 90.3 + rng.random(12) / 3) / 10)
    for sign in (1, -1):
        found = designs.greedy(cov, 0, 5, sign)
        for k in range(1, 5):
            chosen = [c for c, _ in found[:k]]
            each = {j: designs.ess(cov, [*chosen, j]) for j in range(12) if j not in chosen}
            assert found[k][0] == (max if sign == 1 else min)(each, key=each.get) and abs(found[k][1] - each[found[k][0]]) < 1e-9


def test_source_checks(spark, tmp_path):
    from stationwise.sources import checks

    checks.require_tables(spark, DATA, ["events", "region"])
    with pytest.raises(FileNotFoundError, match="nothing, other"):
        checks.require_tables(spark, DATA, ["events", "other", "nothing"])
    rows = spark.createDataFrame([("a", 1, 2.5), ("b", 2, None), ("b", 3, 1.0)], "city string, n int, v double")
    rows.coalesce(1).write.option("header", True).csv(f"{tmp_path}/t")
    keys = rows.select("city").distinct()
    found = checks.scan_csv(spark, f"{tmp_path}/t", "city string, n int, v double", F.col("n") > 0, keys)
    assert found.count() == 3
    with pytest.raises(ValueError, match="'a'"):
        checks.scan_csv(spark, f"{tmp_path}/t", "city string, n int, v double", F.col("n") > 1, keys)
    assert checks.one_row(rows, city="a")["v"] == 2.5
    for wrong in ({"city": "b"}, {"city": None}):
        with pytest.raises(LookupError):
            checks.one_row(rows, **wrong)
    assert checks.canonical(rows, city=["b"], n=[2, 9]).count() == 1


def test_sinks(spark, tmp_path):
    from stationwise.sources import sinks

    rows = spark.createDataFrame([("a", 1, dt.date(2024, 1, 1), 1.5), ("a", 1, dt.date(2024, 1, 1), 1.5), ("b", 2, dt.date(2024, 1, 2), None)], "sensor_id string, city int, date date, value double")
    sinks.write_both(rows, f"{tmp_path}/both", ["sensor_id", "date"])
    assert spark.read.parquet(f"{tmp_path}/both/parquet").count() == spark.read.option("header", True).csv(f"{tmp_path}/both/csv").count() == 2
    assert sorted(map(tuple, sinks.write_panel(rows, f"{tmp_path}/panel").select(*rows.columns).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert spark.read.option("header", True).csv(f"{tmp_path}/panel/inventory").count() == 2
    assert sinks.write_draws(rows, f"{tmp_path}/draws", "city", "date").where("city = 1").count() == 2
    sinks.write_figure_data(rows, f"{tmp_path}/figure", {"value": "pm25"})
    assert spark.read.option("header", True).csv(f"{tmp_path}/figure").columns == ["pm25"]
    sinks.write_provenance(spark, f"{tmp_path}/facts", {"draws": 5})
    assert sinks.read_provenance(spark, f"{tmp_path}/facts")["draws"] == 5


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_runs(spark):
    days = [(1, 0, "a", dt.date(2024, 1, i), None if i in (1, 2, 5, 9, 10) else 1.0) for i in range(1, 11)]
    g = spark.createDataFrame(days, "k int, city int, sensor_id string, date date, value double")
    got = sorted((r.first_date.day, r.last_date.day, r.days) for r in gaps.missing_runs(g).collect())
    assert got == [(1, 2, 2), (5, 5, 1), (9, 10, 2)]


def test_constant_series_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)] + [(None, 2.0)], "x double, y double")
    assert df.agg(exprs.correlation("x", "y")).first()[0] is None
    assert df.agg(exprs.correlation("y", "y")).first()[0] == pytest.approx(1)
    assert df.where("x IS NULL").agg(exprs.correlation("x", "y")).first()[0] is None


def test_expressions(spark):
    one = spark.range(1)
    got = one.select(exprs.monday(F.lit("2024-01-01").cast("date")).alias("a"), exprs.monday(F.lit("2024-01-02").cast("date")).alias("b"), exprs.ratio(F.lit(1), F.lit(0)).alias("c"), exprs.fpc(F.lit(5), F.lit(5)).alias("d"), exprs.season(F.lit(12), exprs.MONSOON).alias("e")).first()
    assert (got.a, got.b, got.c, got.d, got.e) == (dt.date(2024, 1, 1), dt.date(2024, 1, 8), None, 0.0, "winter")
    assert exprs.t_quantile(0.975, 10) == pytest.approx(2.2281, abs=2e-3) and exprs.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_links_by_cells_match_all_pairs(spark):
    rng = random.Random(4)
    rows = [("a" if i % 2 else "b", str(i), rng.uniform(59, 61.5), rng.uniform(-0.6, 0.6)) for i in range(150)]
    s = spark.createDataFrame(rows, "city string, sensor_id string, lat double, lon double")
    near = {(r.a, r.b) for r in spatial.within(s, 12.0).collect()}
    want = {(r.a, r.b) for r in spatial.pairs(s).where("km > 0 AND km <= 12").collect()}
    assert near == want | {(b, a) for a, b in want} and want


def test_hull(spark):
    rng = random.Random(5)
    points = [(1, rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(400)] + [(1, x, y) for x in (-1.0, 2.0) for y in (-1.0, 2.0)] + [(2, 0.0, 0.0), (2, None, 1.0)]
    df = spark.createDataFrame(points, "g long, x double, y double").repartition(4)
    got = {(r.x, r.y) for r in spatial.hulls(df, "g", "x", "y").where("g = 1").collect()}
    assert got == {(x, y) for x in (-1.0, 2.0) for y in (-1.0, 2.0)}


def test_sources(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("Time,s1,s 2,other\n2024-01-01 00:00:00+06:00,1.5,x,9\nbad,1,2,3\n2024-01-01T01:00:00Z,,2,9\n")
    got = {(str(r.ts), r.sensor_id, r.value) for r in panel.wide_csv(spark, str(tmp_path / "wide.csv"), ["s1", "s 2", "s9"]).collect()}
    assert got == {("2024-01-01 00:00:00", "s1", 1.5), ("2024-01-01 00:00:00", "s 2", None), ("2024-01-01 01:00:00", "s1", None), ("2024-01-01 01:00:00", "s 2", 2.0)}
    with pytest.raises(ValueError, match="known sensor"):
        panel.wide_csv(spark, str(tmp_path / "wide.csv"), ["none"])
    (tmp_path / "loc.csv").write_text("Sensor_ID,Latitude,Longitude,Station_Name\n1,23.5,90.1,A\n2,x,90,B Collocation 2\n1,0,0,Z\n3,1,2,\n")
    loc = {r.sensor_id: (r.lat, r.station) for r in panel.locations_csv(spark, str(tmp_path / "loc.csv")).collect()}
    assert loc == {"1": (23.5, "A"), "2": (None, "B Collocation 2"), "3": (1.0, "3")}
    assert panel.locations_csv(spark, str(tmp_path / "loc.csv"), exclude_collocated=True).count() == 2
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    (tmp_path / "shape.geojson").write_text(json.dumps(shape))
    edges = panel.polygon_edges(spark, str(tmp_path / "shape.geojson"))
    assert edges.count() == 12
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 1.0), (3, -1.0, 2.0)], "k long, x double, y double")
    assert [r.k for r in spatial.in_polygon(points, edges.where("feature = 0"), "x", "y", "k").collect()] == [1]


def test_streams_match_batches(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    r = panel.readings(spark, DATA)
    batch = {(x.sensor_id, x.date, x.n): round(x.value, 6) for x in panel.daily(r).collect()}
    got = {(x.sensor_id, x.date, x.n): round(x.value, 6) for x in stream.run_to_end(stream.daily_means(stream.reading_stream(spark, f"{tmp_path}/in", 10)), "daily_stream", "complete").collect()}
    assert got == batch
    s = stream.run_to_end(stream.sliding_network_mean(stream.reading_stream(spark, f"{tmp_path}/in", 10)), "week_stream", "complete")
    assert s.agg(F.sum("n")).first()[0] == 7 * r.count()
    sessions = stream.run_to_end(stream.activity_sessions(stream.reading_stream(spark, f"{tmp_path}/in", 10)), "session_stream", "complete")
    assert sessions.agg(F.sum("n")).first()[0] == r.count()
    found = stream.run_to_end(stream.outages(stream.reading_stream(spark, f"{tmp_path}/in", 10)), "outage_stream")
    from pyspark.sql import Window

    silent = r.select("sensor_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("p", F.lag("ts").over(Window.partitionBy("sensor_id").orderBy("ts"))).where("ts - p >= INTERVAL 24 HOURS")
    assert found.count() == silent.count() > 0
    once = stream.run_to_end(stream.without_repeats(stream.reading_stream(spark, f"{tmp_path}/in", 10)), "once_stream")
    assert once.count() == r.select("sensor_id", "ts").distinct().count()

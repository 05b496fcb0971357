"""Compression limits that are fitted to few or many labelled documents."""

from __future__ import annotations

import random

import pytest
import zstandard
from pyspark.sql import functions as F
from test_text_operators import junk, prose

from stationwise.llm import quality


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(21)
    sizes = [300, 700, 1_500, 3_000, 6_000, 14_000, 40_000]
    good = [(i, prose(rng, int(rng.choice(sizes[: 1 + i % 7]) * rng.uniform(0.7, 1.4))).decode()) for i in range(900)]
    bad = [(10_000 + i, junk(("noise", "encoded", "repetition")[i % 3], rng, 2_000 + 900 * (i % 9)).decode()) for i in range(60)]
    return spark.createDataFrame(good + bad, "doc_id long, text string").repartition(4).cache()


@pytest.mark.parametrize("n", [0, 1, 3, 10, 400])
def test_unseen_documents_stay_whatever_the_labels(spark, documents, n):
    labels = spark.createDataFrame([(i, 1) for i in range(n)] + [(i, 0) for i in range(800, 820)], "doc_id long, quality int")
    bands = quality.fit_limits(documents, labels)
    assert (bands == quality.Bands()) == (n < 100)
    judged = quality.quality_rules(documents, bands=bands).where("NOT base_failed OR doc_id >= 10000").select("doc_id", "kept").collect()
    unseen = [r.kept for r in judged if n <= r.doc_id < 10_000]
    assert sum(not k for k in unseen) <= 0.02 * len(unseen)
    assert not any(r.kept for r in judged if r.doc_id >= 10_000)


def test_a_length_with_few_texts_keeps_the_wide_limits(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 1_000).decode()) for i in range(150)] + [(500, "a b " * 8_000)]  # one odd text of its length
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands = quality.fit_limits(docs, spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int"))
    wide = {n: x for n, *x in quality.WHOLE_LIMITS}
    assert {n for n, *x in bands.whole if wide.get(n) != x} == {1_024}
    assert [n for n, _, _ in bands.chunks] == [n for n, _, _ in quality.CHUNK_LIMITS]


def test_limits_come_from_all_labelled_texts(spark):
    rng = random.Random(8)
    texts, odd = [prose(rng, 700).decode() for _ in range(50)], "so it goes on and on. " * 32
    ids = [r.id for r in spark.range(25_000).orderBy(F.xxhash64("id")).collect()]
    # the 300 odd texts have the largest hashes: the 20,000 least ones, which were read before, do not show them
    kinds = spark.createDataFrame([(i, k % 50 if k < 24_700 else 50) for k, i in enumerate(ids)], "doc_id long, k int")
    docs = kinds.join(spark.createDataFrame(list(enumerate([*texts, odd])), "k int, text string"), "k")
    bands = quality.fit_limits(docs, docs.selectExpr("doc_id", "1 AS quality"))
    low, high = next(x for n, *x in bands.whole if n == 512)
    z = zstandard.ZstdCompressor(level=3, write_content_size=False)
    ratios = [len(t) / len(z.compress(t.encode())) for t in [*texts, odd]]
    assert low == pytest.approx(min(ratios) * 0.95, rel=0.001)
    assert high == pytest.approx(max(ratios) * 1.05, rel=0.001)

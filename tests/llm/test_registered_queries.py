"""Queries as they are registered, against plain loops over the smallest tables."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from stationwise.llm import html_extract, registry, sharding

DATA = "/root/testdata/sf0.001"


def jump(key: int, shards: int) -> int:
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        to = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


def test_jump_hash_against_a_scalar_loop():
    keys = np.random.default_rng(6).integers(-(1 << 63), (1 << 63) - 1, 3_000)
    for shards in (1, 2, 16, 17, 1_000):
        assert sharding.jump_hash(keys, shards).tolist() == [jump(int(k) % (1 << 64), shards) for k in keys]


def test_op6(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    rows = registry.QUERIES["op6_jump_hash"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    assert all(r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) for r in rows)
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


def test_op8_gives_every_page_and_counts_code_points(spark):
    pages = {r["page_id"]: r for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist()}
    rows = registry.QUERIES["op8_wrapper_induction"](spark, DATA).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    assert all(r.url == pages[r.page_id]["url"] and r.n_chars == len(r.text) for r in rows)
    assert all(line == " ".join(line.split()) and line for r in rows if r.text for line in r.text.split("\n"))
    assert sum(bool(r.text) for r in rows) > 0.9 * len(rows)
    assert html_extract.texts_of([None, ""]) == ["", ""]


@pytest.mark.parametrize("name", ["op10_compression_bands"])
def test_op10(spark, name):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    rows = registry.QUERIES[name](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        words = texts[r.doc_id].encode().split()
        assert r.n_words == len(words) and not (r.kept and r.base_failed) and (len(words) >= 20 or r.base_failed)

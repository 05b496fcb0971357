"""Quality rules, line dedup, substring dedup and near-duplicates against brute force on small texts."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationwise.llm import components, fm_index, hashing, line_dedup, near_dup, quality, substring

SCHEMA = "doc_id long, text string, source string, k_id string, drops string"


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, repeated lines, nulls, empty and long texts, repeated rows."""
    rng = random.Random(3)
    base = [words(rng, rng.randrange(1, 160)) for _ in range(40)]
    passage = words(rng, 70)
    texts = [" ".join(b) for b in base]
    for b in base[:10]:
        near = list(b)
        near[rng.randrange(len(near))] = "changed"
        texts += [" ".join(near), " ".join(b)]
    long_base = words(rng, 120)
    for _ in range(12):
        near = list(long_base)
        for _ in range(rng.randrange(1, 4)):
            near[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(near))
    texts += [" ".join(words(rng, 20) + passage + words(rng, 9)) for _ in range(6)]
    line = "  A Line that Many documents hold, word for word "
    texts += [f"{' '.join(words(rng, 8))}\n{line}\n\n{line.lower()}\nshort" for _ in range(7)]
    texts += [None, "", " \t\n ", "é" * 45 + "\n" + "é" * 45, " ".join(words(rng, 30_000)), "one two", "One  TWO"]
    rows = [(i, t, f"s{i % 3}", "other", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[45], (None, texts[0], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row) -> tuple:
    return (row.doc_id is not None, row.doc_id or 0, row.text is not None, row.text or "")


def test_quality(docs, empty):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        w = (r.text or "").split() if r.text is None or r.text.isascii() else r.text.split()
        seen, again = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                again.update(range(i, i + 8))
        lines = [x for x in (r.text or "").split("\n") if x.split()]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(again))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.quality_rules(empty).count() == 0


@pytest.fixture(scope="module")
def z():
    import zstandard

    return zstandard.ZstdCompressor(level=3, write_content_size=False)


def prose(rng: random.Random, n: int) -> bytes:
    """Sentences of invented words whose letters and frequencies resemble prose."""
    parts = "the re in er st an ti on ed es ha or en nd th at ou it is ing ea wh as hi be to of le ".split()
    known = ["".join(rng.choice(parts) for _ in range(1 + int(rng.expovariate(0.6)))) for _ in range(4_000)]
    weights, out, size = list(accumulate(1 / (k + 8) for k in range(4_000))), [], 0
    while size < n:
        sentence = " ".join(rng.choices(known, cum_weights=weights, k=rng.randrange(6, 20))).capitalize() + ". "
        out.append(sentence)
        size += len(sentence)
    return "".join(out).encode()[:n]


LENGTHS = (300, 600, 1_300, 3_000, 7_000, 20_000, 90_000)


def junk(kind: str, rng: random.Random, n: int) -> bytes:
    import base64

    if kind == "noise":
        return bytes(rng.randrange(33, 127) for _ in range(n))
    if kind == "encoded":
        return base64.b64encode(rng.randbytes(n))[:n]
    return (b"again and again the same " * (n // 25 + 1))[:n]


@pytest.mark.parametrize("kind", ["noise", "encoded", "repetition"])
def test_bands_reject_planted_junk(z, kind):
    rng = random.Random(kind)
    verdict = lambda raw: quality.band_verdict(raw, quality.Bands(), z)[2]
    for n in LENGTHS:
        clean = prose(rng, n)
        assert verdict(clean), n
        assert not verdict(junk(kind, rng, n)), n
        if n > 1_000:  # two fifths of the text, at its end, its start or inside
            part = junk(kind, rng, 2 * n // 5)
            assert not verdict(clean[: 3 * n // 5] + part) and not verdict(part + clean[: 3 * n // 5]), n
            assert not verdict(clean[: n // 3] + part + clean[n // 3 : 3 * n // 5]), n


def test_the_last_bytes_are_judged(z):
    rng = random.Random(7)
    for size, _, _ in quality.CHUNK_LIMITS:
        clean = prose(rng, 5 * size)
        bands = quality.Bands(chunks=tuple(c for c in quality.CHUNK_LIMITS if c[0] == size))
        share = lambda raw, bands=bands: quality.band_verdict(raw, bands, z)[1]
        assert share(clean) == share(clean[: size + 1]) == share(clean[:size]) == 0
        assert share(clean[: size + 1 + size // 2]) == 0  # a partial last chunk
        noise = junk("noise", rng, size - 1)
        assert share(clean[: 2 * size] + noise) == 1 / 3  # a tail shorter than a chunk
        assert share(clean[: size // 2] + noise) >= 1 / 2  # less than two chunks


def test_limits_fit_labelled_texts(spark, z):
    rng = random.Random(5)
    good = [(i, prose(rng, rng.choice(LENGTHS[1:6])).decode()) for i in range(120)]
    bad = [(1_000 + i, junk("noise", rng, 2_000).decode()) for i in range(40)]
    docs = spark.createDataFrame([*good, *bad, (5_000, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(5_000, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    bands = quality.fit_limits(docs, labels)
    kept = sum(quality.band_verdict(t.encode(), bands, z)[2] for _, t in good)
    assert kept >= 0.95 * len(good) and not any(quality.band_verdict(t.encode(), bands, z)[2] for _, t in bad)
    assert quality.band_verdict(prose(rng, 200_000), bands, z)[2]  # longer than any that the limits were fitted to
    assert quality.fit_limits(docs, labels.limit(0)) == quality.Bands()


def line_brute(rows: list[tuple], min_chars: int = 40, min_docs: int = 5) -> dict:
    def of(text):
        return [(x, x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})) for x in (text or "").split("\n")]

    holders = defaultdict(list)
    for doc, text in rows:
        for k in {k for _, k in of(text) if len(k) >= min_chars}:
            holders[k].append(doc)
    out = {}
    for doc, text in rows:
        last = lambda k: max(holders[k], key=lambda d: (d is not None, d or 0))
        keep = [x for x, k in of(text) if not (len(k) >= min_chars and len(holders[k]) >= min_docs and last(k) != doc)]
        out[doc, text] = (len(of(text)), len(of(text)) - len(keep), "\n".join(keep))
    return out


@pytest.mark.parametrize("probe_bytes", [1 << 20, -1])
def test_lines(docs, empty, probe_bytes):
    want = line_brute([(r[0], r[1]) for r in corpus()])
    got = line_dedup.dedup_lines(docs, probe_bytes=probe_bytes).collect()
    assert len(got) == len(corpus()) and any(r.n_dropped for r in got)
    for r in got:
        assert (r.n_lines, r.n_dropped, r.kept_text) == want[r.doc_id, r.text]
    assert line_dedup.dedup_lines(empty, probe_bytes=probe_bytes).count() == 0


def test_line_index_is_reversible(spark, docs):
    lines = line_dedup.line_keys(docs)
    index = line_dedup.LineIndex.of(lines)
    more = spark.createDataFrame([(10_000 + i, "A line that comes later, and comes in many documents") for i in range(6)], "doc_id long, text string")
    new = line_dedup.line_keys(more)
    grown = index.insert(new)
    assert grown.drops(new).count() == 5
    back = grown.delete(more.select("doc_id").withColumnRenamed("doc_id", "k_id"))
    assert back.candidates(new).count() == 0 and sorted(back.all_refs().collect(), key=repr) == sorted(index.all_refs().collect(), key=repr)
    assert sorted(back.frequent().collect(), key=repr) == sorted(index.frequent().collect(), key=repr)


def test_line_index_grows_from_nothing(spark):
    """100,000 keys into an empty index and out again; filters and shards grow with them."""
    kind = "k_id long, k_text long, pos int, h1 long, h2 long, first boolean"
    index = line_dedup.LineIndex.of(spark.createDataFrame([], kind), min_docs=2, shard_keys=5_000)
    assert index.shards == 1 and index.candidates(spark.createDataFrame([], kind)).count() == 0
    lines = lambda n, doc: spark.range(n).select(F.lit(doc).alias("k_id"), F.lit(0).cast("long").alias("k_text"), F.col("id").cast("int").alias("pos"), F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"), F.lit(True).alias("first"))
    index = index.insert(lines(100_000, 1)).insert(lines(3_000, 2))
    assert index.frequent().count() == 3_000 and index.shards == 1
    index = index.insert(lines(100_000, 3))
    assert index.frequent().count() == 100_000 and index.shards > 5
    blobs = [line_dedup.CuckooFilter.load(bytes(r.blob)) for r in index.filters.read().collect()]
    assert sum(len(b.stash) for b in blobs) < 100 and index.candidates(lines(100_000, 4)).count() == 100_000
    one = index.insert(spark.createDataFrame([(9, 0, 0, 11, 12, True)], kind))
    assert sum(one.refs.folders[s] != f for s, f in index.refs.folders.items()) == 1  # only the touched shard is written anew
    few = index.delete(spark.createDataFrame([(3,)], "k_id long"))
    assert few.frequent().count() == 3_000 and {r.last for r in few.frequent().select("last").distinct().collect()} == {2}
    assert few.candidates(lines(100_000, 4)).count() < 3_300
    none = few.delete(spark.createDataFrame([(1,), (2,)], "k_id long"))
    assert none.all_refs().count() == none.frequent().count() == none.candidates(lines(100_000, 4)).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 5_000, np.uint64)
    f = line_dedup.CuckooFilter(5_000)
    f.insert(keys)
    f = line_dedup.CuckooFilter.load(f.dump())
    assert f.contains(keys).all() and f.contains(rng.integers(0, 1 << 63, 20_000, np.uint64)).mean() < 0.01
    f.delete(keys[:2_500])
    assert f.contains(keys[2_500:]).all() and f.contains(keys[:2_500]).mean() < 0.01
    full = line_dedup.CuckooFilter(16)
    full.insert(keys[:200])
    assert full.contains(keys[:200]).all()


def test_fm_index():
    rng = np.random.default_rng(2)
    word = lambda n: [b"%d" % k for k in rng.integers(0, 4, n)]
    texts = [word(rng.integers(5, 40)) for _ in range(30)]
    texts[7] = list(texts[3][2:20])
    owners = rng.integers(0, 9, 30)
    index = fm_index.FMIndex(texts, owners, 5)
    held = [(u[k : k + n], o) for u, o in zip(texts, owners, strict=True) for n in range(1, 6) for k in range(len(u) - n + 1)]
    # texts that the index has, and others: of its words, and with words that it does not have
    streams = [*texts, *(word(30) for _ in range(5)), [b"0", b"1", b"strange", b"2", b"3", b"0", b"1"], [], [b"strange"]]
    for t, length, least in zip(streams, *index.matching([index.encode(t) for t in streams]), strict=True):
        for i in range(len(t)):
            longest = max((n for n in range(1, min(5, len(t) - i) + 1) if any(h == t[i : i + n] for h, _ in held)), default=0)
            assert length[i] == longest
            own = [o for h, o in held if h == t[i : i + 5]] if longest == 5 else []
            assert least[i] == min(own, default=-1) and (longest < 5 or index.count(t[i : i + 5]) == len(own))
    assert index.count([b"9"]) == 0


def test_fm_index_is_compressed():
    rng = np.random.default_rng(3)
    texts = [[b"%d" % k for k in rng.zipf(1.3, 70) % 5_000] for _ in range(1_000)]
    index = fm_index.FMIndex(texts, np.arange(1_000), 50)
    assert index.nbytes < 14 * index.n  # the suffix array alone would be 8 bytes a word, its inverse and shared lengths as many


def test_runs_of_words_have_hashes_of_their_own():
    words = np.array([hashing.WordHashes().of([b"a", b"b"])[bin(k).count("1") % 2] for k in range(1_024)], np.uint64)
    other = np.where(words == words[0], words[1], words[0])
    assert hashing.runs(words, 1_024)[0] != hashing.runs(other, 1_024)[0]  # the two Thue-Morse words
    for width in (1, 2, 5, 20, 50):
        seen = {}
        for text in (words, other):
            for k, h in enumerate(hashing.runs(text, width)):
                assert seen.setdefault(h, text[k : k + width].tobytes()) == text[k : k + width].tobytes()
        assert len(hashing.runs(words, width)) == 1_025 - width and len(set(seen.values())) == len(seen)
    assert len(hashing.runs(words[:3], 5)) == 0


def span_brute(rows: list[tuple], window: int) -> dict:
    first: dict[tuple, int] = {}
    for doc, text in rows:
        w = (text or "").split()
        if doc is not None:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                first[g] = min(first.get(g, doc), doc)
    out = {}
    for doc, text in rows:
        w, gone = (text or "").split(), set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out[doc, text] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize(("window", "anchor", "hot"), [(50, 20, 1_000), (12, 5, 3)])
def test_substrings(docs, empty, window, anchor, hot):
    want = span_brute([(r[0], r[1]) for r in corpus()], window)
    got = substring.remove_repeats(docs, window=window, anchor=anchor, hot=hot).collect()
    assert len(got) == len(corpus()) and sum(r.n_removed > 0 for r in got) > 10
    for r in got:
        assert (r["n_words"], r.n_removed, r.kept_text) == want[r.doc_id, r.text]
    assert substring.remove_repeats(empty, window=window, anchor=anchor).count() == 0


def near_brute(rows: list[tuple]) -> dict:
    def of(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [of(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return {(d, t): (len(s), d if not s else least.get(root(i))) for i, ((d, t), s) in enumerate(zip(rows, sets, strict=True))}


@pytest.mark.parametrize(("block", "key_block"), [(512, 4_096), (2, 2)])
def test_near_duplicates(docs, empty, block, key_block):
    rows = [(r[0], r[1]) for r in corpus()]
    want = near_brute(rows)
    texts = {(r.doc_id, r.k_text): r for r in near_dup.near_duplicates(docs, block=block, key_block=key_block).collect()}
    hashes = docs.select("doc_id", "text", F.xxhash64("text", F.length("text")).alias("h")).collect()
    for r in hashes:
        got = texts[r.doc_id, r.h]
        assert (got.n_shingles, got.component_id) == want[r.doc_id, r.text], r.text
        assert got.kept == (got.doc_id == got.component_id)
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.keep_one(docs).columns == docs.columns


def test_a_chain_of_near_copies(spark):
    """Each text is linked with the next one only; all are one group, though the ends have nothing in common."""
    rng = random.Random(8)
    w = words(rng, 3_000, 1 << 40)
    rows = [(i, " ".join(w[4 * i : 4 * i + 130])) for i in range(700)] + [(10_000 + i, " ".join(words(rng, 40))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (512, 16):
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, block=block).collect()}
        assert got == {i: 0 if i < 700 else i for i, _ in rows}


def test_hubs_do_not_change_components(spark):
    rng = random.Random(9)
    edges = [(0, k) for k in range(1, 60)] + [(70, k) for k in range(71, 130)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(59, 129), (5, 5)]
    up = list(range(400))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = {n: root(n) for e in edges if e[0] != e[1] for n in e}
    df = spark.createDataFrame(edges, "a long, b long")
    for hub in (2_000, 3):
        assert {r.node: r.root for r in components.components(df, hub=hub).collect()} == want


def test_keys_of_one_class_go(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(c)) for k, c in zip(rng.integers(0, 300, 700), rng.permutation(700), strict=True)] + [(1_000, 10_000 + c) for c in range(57)]
    by = defaultdict(set)
    for k, c in rows:
        by[k].add(c)
    df = spark.createDataFrame(rows, "key long, c8 long")
    for batch in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = near_dup._shared(df, 10).collect()
        found = defaultdict(list)
        for r in got:
            found[r.key].append(r)
        assert set(found) == {k for k, c in by.items() if len(c) > 1}
        for k, rs in found.items():
            members = [r for r in rs if r.c8 is not None]
            assert {r.c8 for r in members} == by[k] and len(members) == len(by[k])
            assert [r.blocks for r in rs if r.c8 is None] == ([-(-len(by[k]) // 10)] if len(by[k]) > 10 else [])
            assert max(Counter(r.block for r in members).values()) <= 10
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_all_pairs_within_distance_share_a_key():
    rng = np.random.default_rng(4)
    chosen = near_dup.masks()
    for _ in range(300):
        wrong = rng.choice(near_dup.HASHES, near_dup.DISTANCE, replace=False)
        assert any(not set(m.tolist()) & set(wrong.tolist()) for m in chosen)


@pytest.mark.parametrize(("percent", "distance"), [(75, 25), (80, 22), (85, near_dup.DISTANCE), (95, 12)])
def test_distance_follows_the_similarity(percent, distance):
    rng = np.random.default_rng(5)
    found, chunks = near_dup.distance_of(percent)
    assert found == distance and (percent != 85 or chunks == near_dup.CHUNKS)
    chosen = near_dup.masks(distance=found, chunks=chunks)
    assert len(chosen) == near_dup.HASHES and min(map(len, chosen)) >= 2
    for _ in range(300):
        wrong = rng.choice(near_dup.HASHES, found, replace=False)
        assert any(not set(m.tolist()) & set(wrong.tolist()) for m in chosen)


def test_similarities_that_signatures_cannot_serve_are_refused(docs):
    for percent in (0, 60, 101):
        with pytest.raises(ValueError, match="similarity"):
            near_dup.near_duplicates(docs, percent=percent)


def test_forests_keep_components():
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 256, (4, 40)).astype(np.uint8)
    sig = centre[rng.integers(0, 4, 120)].copy()
    for row in sig:
        row[rng.choice(40, 8, replace=False)] += 1
    edges = near_dup.within_distance(sig)
    forest, full = near_dup.Forest(120), near_dup.Forest(120)
    for a, b in edges:
        assert forest.join(a, b)
    for a in range(120):
        for b in range(a):
            if (sig[a] != sig[b]).sum() <= near_dup.DISTANCE:
                full.join(a, b)
    assert (forest.labels() == full.labels()).all()

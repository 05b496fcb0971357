"""Phrases, byte-level BPE and the filter audit against brute force, the tokenizers library and enumeration."""

from __future__ import annotations

import random
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stationwise.llm import bpe, collocations, filter_audit

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, ids string, word string"


def prose(rng: random.Random, n: int) -> str:
    words = ["Red", "green", "blue", "new", "york", "city", "of", "the", "in", "ünder", "a-b", "x1"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", " ; ", "?! "]
    return "".join(rng.choice(words) + rng.choice(ends) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randrange(0, 90)), rng.choice(["en", "de", None]), f"s{i % 3}" if i % 7 else None, "x", "y") for i in range(120)]
    return out + [(200, None, "en", "s1", None, None), (201, "", None, None, "x", None), (None, "new york city", "en", "s0", "x", "y"), out[3], out[3], (202, "new york " * 3_000, "en", "s1", "x", "y")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def phrases(rows: list[tuple], most: int = 3) -> tuple[Counter, Counter]:
    f, n = Counter(), Counter()
    for r in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        for piece in regex.split(r"[.,;:!?\x0A-\x0D]", text):
            w, lang = regex.findall(r"[^\x20\x09]+", piece), r[2] or "und"
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    return f, n


def best_phrases(rows: list[tuple], min_count: int, top: int) -> list[tuple]:
    f, n = phrases(rows)
    good = {k: a for k, a in f.items() if a >= min_count and len(k[1]) > 1}
    out = []
    for (lang, p), a in good.items():
        score, k, l, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
        longer = [b for (g, q), b in good.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * b >= 50 * a for b in longer):
            out.append((lang, " ".join(p), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank, found = Counter(), []
    for x in out:
        rank[x[0]] += 1
        if rank[x[0]] <= top:
            found.append((x[0], rank[x[0]], *x[1:]))
    return found


@pytest.mark.parametrize("block", [4 << 20, 900])
def test_collocations(docs, rows, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    got = collocations.collocations(*collocations.frequent_phrases(docs, min_count=4), top=40)
    assert sorted(tuple(r)[:8] for r in got.collect()) == best_phrases(rows, 4, 40)


def test_pointers_lead_to_the_phrase(docs, rows):
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in collocations.collocations(*collocations.frequent_phrases(docs, min_count=4), top=30).where("first_doc IS NOT NULL").collect():
        words = [w for piece in regex.split(r"[.,;:!?\x0A-\x0D]", texts[r.first_doc].lower()) for w in regex.findall(r"[^\x20\x09]+", piece)]
        k = len(r.phrase.split(" "))
        assert " ".join(words[r.first_word : r.first_word + k]) == r.phrase


def test_fingerprints():
    """Equal n-grams of a language share fingerprints, whatever lies between their words."""
    prints = collocations.Fingerprints()
    block = prints.block([(False, 1, 0, "en", b"New York, new  york\tnew york!"), (False, 2, 0, "de", b"new york"), (False, 3, 0, "en", b"york new")])
    at = block.grams(2)
    fp = prints.grams(block, 2, at)
    assert block.phrases(at, 2).to_pylist() == [b"new york", b"new york", b"york new", b"new york", b"new york", b"york new"]
    assert fp[0] == fp[1] == fp[3] and fp[4] != fp[0] and fp[2] == fp[5] != fp[0]
    long = prints.block([(False, 1, 0, "en", b"x" * (3 * collocations.PREFIX_BYTES) + b" y x")])
    assert [len(x) for x in long.phrases(long.grams(1), 1).to_pylist()] == [3 * collocations.PREFIX_BYTES, 1, 1] and len(set(long.hashes.tolist())) == 3


def test_colliding_words_are_told_apart_by_their_bytes():
    words = [b"w%d" % i for i in range(400)]
    crowded = collocations.Fingerprints(4).block([(False, 1, 0, "en", b" ".join(words + words))])
    assert len(set(crowded.hashes.tolist())) <= 16
    exact = crowded.exact_words().tolist()
    assert len(set(exact)) == 400 and exact[:400] == exact[400:]


@pytest.mark.parametrize("bits", [1, 5, 9])
def test_collocations_with_few_bits(docs, rows, bits):
    """However often fingerprints collide, phrases and counts are the same."""
    got = collocations.collocations(*collocations.frequent_phrases(docs, min_count=4, bits=bits), top=40)
    assert sorted(tuple(r)[:8] for r in got.collect()) == best_phrases(rows, 4, 40)


def test_counts_are_exact_whatever_collides(docs, rows):
    """Tables of bits that mark everything let all n-grams through; the counts by text stay exact."""
    full = [np.full(8, 255, np.uint8)] * 3
    rows_ = collocations._rows(docs, "doc_id", "text", "lang")
    got = {(r.lang, tuple(bytes(r.phrase).decode().split(" "))): r.f for r in collocations.verified(rows_, full, 3).collect()}
    assert got == dict(phrases(rows)[0])


def test_no_phrases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(*collocations.frequent_phrases(empty)).count() == 0
    lone = spark.createDataFrame([(1, "a b c", "en", "s", "x", "y"), (2, None, None, None, None, None)], SCHEMA)
    assert collocations.collocations(*collocations.frequent_phrases(lone)).count() == 0


def test_scores_beyond_64_bits(spark):
    a = 3_000_000_019
    p = spark.createDataFrame([("en", 1, b"x", a + 5, 1, 1), ("en", 1, b"y", a + 77, 1, 1), ("en", 2, b"x y", a, 1, 1)], "lang string, size int, phrase binary, f long, doc long, word long")
    r = collocations.collocations(p, spark.createDataFrame([("en", 9 * a)], "lang string, n long")).first()
    assert (r.a, r.l, r.r, r.n, r.score) == (a, a + 5, a + 77, 9 * a, 1_000_000 * a * a // ((a + 5) * (a + 77)))


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary.of(f.read())


def odd_texts() -> list[str]:
    rng = random.Random(9)
    letters = "aAbé 0①\n\t\r's  <|>ü漢՘࢏€　\x00 \x1c\x85😀ſ.,'ll've"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 70))) for _ in range(800)]
    return [*out, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "x" * 5_000, "ab" * 3_000, " " * 900, "\n \n" * 300, "漢é" * 500, "don't we've I'll", "DON'T"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "en", "s", None, "w") for i, t in enumerate(odd_texts())] + [(9_000, None, None, None, None, None), (9_001, "", "en", "s", "x", "y"), (None, "no id", "en", "s", "x", "y"), (3, "twice", "en", "s", "x", "y"), (3, "twice", "en", "s", "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("words", [0, 40, 100_000])
def test_encoding_equals_the_library(texts, library, words, monkeypatch):
    with open(PATH, "rb") as f:
        lexicon = bpe.build_lexicon(texts, f.read(), most=words)
    assert (len(bpe.Lexicon(lexicon).starts) > 1) == (words > 0)
    got = bpe.tokenize(texts, PATH, decode=True, lexicon=lexicon).collect()
    assert len(got) == texts.count()
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False) == (r.text or "")


def test_words_over_blocks(texts, library, vocabulary, monkeypatch):
    """Cuts between blocks change nothing."""
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 64)
    encoder = bpe.Encoder(vocabulary, bpe.Lexicon(bpe.Lexicon.compiled({})), bpe.word_pattern())
    long = [" ".join(odd_texts()), "a b" * 400, ""]
    ids, counts = encoder.encode([*long, None])
    assert counts[-1] == counts[-2] == 0
    for k, text in enumerate(long):
        at = int(counts[:k].sum())
        assert ids[at : at + counts[k]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_decoding_any_ids(spark, library):
    rng = random.Random(4)
    lists = [[rng.randrange(50_257) for _ in range(rng.randrange(0, 40))] for _ in range(200)] + [None, [], [50_256, None, 50_256]]
    df = spark.createDataFrame(list(enumerate(lists)), "k long, ids array<int>")
    for r in bpe.detokenize(df, PATH).collect():
        assert r.decoded == library.decode([i for i in r.ids or [] if i is not None], skip_special_tokens=False)


def test_transducer_is_minimal_and_exact():
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    words = sorted({s + e for s in stems for e in ("", "ing", "ed", "er", "ers")})
    entries = {w.encode(): [rng.randrange(9) for _ in range(rng.randrange(1, 4))] for w in words}
    lexicon = bpe.Lexicon(bpe.Lexicon.compiled(entries))
    place = lexicon.places([w.encode() for w in words])
    assert place.tolist() == list(range(len(words)))
    for w, p in zip(words, place.tolist(), strict=True):
        assert lexicon.ids[lexicon.starts[p] : lexicon.starts[p + 1]].tolist() == entries[w.encode()]
    absent = [b"", b"zzz", b"ab" * 40, *(w.encode() + b"q" for w in words[:50]), *{w[:-1].encode() for w in words} - set(entries)]
    assert (lexicon.places(absent) == -1).all()
    rights = {frozenset(w[k:] for w in words if w.startswith(w_[:k])) for w_ in words for k in range(len(w_) + 1)}  # Nerode's classes
    assert len(lexicon.final) == len(rights)
    assert (bpe.Lexicon(bpe.Lexicon.compiled({})).places([b"a"]) == -1).all()


def test_merging_long_and_short_words_alike(vocabulary, library, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 48))).encode() for _ in range(400)]
    short = vocabulary.merge(words)
    assert short == [vocabulary._merge_long(w) for w in words] == [library.encode(w.decode(), add_special_tokens=False).ids for w in words]


def test_nothing_to_encode(spark, texts):
    assert bpe.tokenize(texts.limit(0), PATH, decode=True).count() == 0
    assert set(bpe.tokenize(texts, PATH).columns) == set(texts.columns)


# the filter audit


def audit(rows: list[tuple], labels: dict) -> dict:
    docs, seen = [], {}
    for doc_id, text, part in rows:
        t = text or ""
        seen.setdefault(t, set()).add(doc_id)
    for doc_id, text, part in rows:
        t = text or ""
        w = regex.findall(r"[^\x20\x09-\x0D]+", t)
        copy = any(i is not None and (doc_id is None or i < doc_id) for i in seen[t])
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(regex.findall("[A-Z]", t)) > 2 * len(t), "D": bool(regex.search(r"[#$%&*|]", t)), "E": copy}
        docs.append((part or "", {f for f, x in fails.items() if x}, *labels.get(doc_id, (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        own, removed = [d for d in docs if d[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                left = [d for d in own if not d[1] & set(order[:k])]
                gone = [d for d in left if f in d[1]]
                removed[f] += len(gone)
                hit = [d for d in own if f in d[1]]
                out[part, order, k + 1] = [len(left) - len(gone), len(gone), len(hit) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for key in out:
            if key[0] == part and isinstance(out[key][-1], str):
                out[key][-1] = removed[out[key][-1]]
    return out


def test_filter_audit(spark):
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["a", "b", "Cc", "D", "e#"][: rng.randrange(1, 6)]) + str(rng.randrange(m)) for _ in range(rng.randrange(150, 260))) for m in (2, 50, 900, 900, 900) for _ in range(8)]
    rows = [(i, rng.choice(texts), rng.choice(["x", "y", None, ""])) for i in range(150)] + [(500, None, "x"), (501, "", "z"), (None, texts[0], "x"), (None, texts[0], "x"), (None, "onlyÉ here", "y"), (7, texts[1], "x"), (7, texts[1], "x")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    flags = {}
    for i, q, t in labels:
        if i is not None:
            g = flags.get(i, (0, 0))
            flags[i] = (max(g[0], int(q == 1)), max(g[1], int(t == 1)))
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, source string, n long, mask string").repartition(4)
    got = filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}
    assert found == audit(rows, flags)
    assert filter_audit.audit_filters(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    sums = got.groupBy("part", "filter_order").agg(F.sum("removed").alias("gone"), F.min("kept").alias("left"))
    sizes = {r.part: r.n for r in docs.groupBy(F.coalesce("source", F.lit("")).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(r.gone + r.left == sizes[r.part] for r in sums.collect())


@pytest.mark.parametrize("name", ["op11_rabin_karp", "op12_transducer_bpe", "op13_sql_folds"])
def test_registered_query(spark, name, library):
    import hashlib

    import duckdb
    import pandas as pd

    from stationwise.llm import registry

    data = "/root/testdata/sf0.001"
    got = registry.QUERIES[name](spark, data).toPandas()
    if name == "op12_transducer_bpe":
        texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
        assert len(got) == len(texts)
        for r in got.itertuples():
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        return
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    want = c.sql(registry.ORACLES[name]).df()
    order = sorted(want.columns)
    pd.testing.assert_frame_equal(got[order].sort_values(order).reset_index(drop=True), want[order].sort_values(order).reset_index(drop=True), check_dtype=False)

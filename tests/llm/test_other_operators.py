"""Mixing, language model, decontamination, sharding, WARC, HTML and the pipeline on small inputs."""

from __future__ import annotations

import io
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationwise.llm import decontaminate, gru, html_extract, lm, mixing, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, shard string"


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(600)}" for _ in range(int(rng.paretovariate(1) * 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t), "x", "y") for i, t in enumerate(texts(1, 300))]
    rows += [(400, None, None, "s1", None, None, None), (401, "", "en", "s2", 0, "x", "y"), (None, "a b c", None, None, 5, None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fill(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed: set = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in fixed)
        free = sum(w[s] for s in names if s not in fixed)
        over = {s for s in names if s not in fixed and left * w[s] / free > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in fixed else left * w[s] / free for s in names}
        fixed |= over


def test_mixing(docs, empty):
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
    want = fill(sizes)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and sorted(got, key=repr) == sorted(mixing.mix_sources(docs).collect(), key=repr)
    by_size = {(s, round(t, 6)) for s, t in ((sizes[k], v) for k, v in want.items())}
    assert {(r.source_size, round(r.target, 6)) for r in got} <= by_size
    for source, size in sizes.items():
        own = [r for r in got if r.source_size == size]
        longest = max(r.size for r in own)
        assert abs(sum(r.copies * r.size for r in own) - want[source]) <= longest / 2 + 1
        assert all(math.floor(r.target / r.source_size - 1e-9) <= r.copies <= 2 for r in own)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_pivot_keeps_expectations():
    p, n = [(0.3, 900), (0.3, 200), (0.7, 180), (0.5, 10)], 4_000
    seen = np.zeros(4)
    for seed in range(n):
        bits, held, left = mixing.pivot(p, random.Random(seed))
        words = sum(b * s for k, (b, (_, s)) in enumerate(zip(bits, p, strict=True)) if k != held) + (left * p[held][1] if held is not None else 0)
        assert abs(words - sum(q * s for q, s in p)) < 1e-6
        seen += [left if k == held else b for k, b in enumerate(bits)]
    assert np.abs(seen / n - [q for q, _ in p]).max() < 0.03


def test_targets_against_brute_force(spark):
    rng = random.Random(8)
    for _ in range(4):
        sizes = {f"s{i}": rng.randrange(0, 200) ** 2 for i in range(9)} | {None: 50}
        df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, n_docs long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(fill(sizes))


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs).collect()
    assert len(got) == docs.count() and {r.shard for r in got} <= set(range(16))
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    assert sharding.assign_shards(empty).count() == 0


def test_jump_hash_moves_only_what_it_must():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 40_000).astype(np.int64)
    before = sharding.jump_hash(keys, 1)
    for n in range(2, 20):
        now = sharding.jump_hash(keys, n)
        moved = now != before
        assert (now[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.02
        assert np.bincount(now, minlength=n).min() > 0.85 * len(keys) / n
        before = now


def small_model(hidden: int = 8) -> gru.Model:
    return gru.fresh(np.sort(np.random.default_rng(2).integers(1, 50, 90))[::-1], np.arange(6.0), hidden, 5)


def test_language_model_is_a_distribution():
    m = small_model()
    h = np.random.default_rng(3).standard_normal((1, 8)).astype(np.float32)
    p = np.exp(gru.log_probs(m, np.repeat(h, 96, 0), np.arange(96)))
    assert abs(p.sum() - 1) < 1e-4
    start = np.exp(gru.log_probs(m, np.zeros((96, 8), np.float32), np.arange(96)))  # before training: the counts alone
    counts = np.append(np.sort(np.random.default_rng(2).integers(1, 50, 90))[::-1], np.arange(6.0)) + 0.1
    assert np.allclose(start, counts / counts.sum(), rtol=1e-3)
    again = m.filled(m.flat())
    assert all((getattr(m, k) == getattr(again, k)).all() for k in ("emb", "word", "cls", "rec", "cuts"))


def test_gradients_and_carried_state():
    rng = np.random.default_rng(4)
    m = small_model()
    for k in ("emb", "into", "rec", "bias", "grp", "grp_bias", "cls", "cls_bias", "word", "word_bias"):
        setattr(m, k, getattr(m, k).astype(np.float64))
    ids, start, real = rng.integers(0, 96, (5, 3)), np.zeros((5, 3), bool), np.ones((5, 3), bool)
    start[0] = start[3, 1] = True
    real[4, 2] = False
    h = np.zeros((3, 8))

    def found() -> tuple[dict, float]:
        word, bias = np.zeros_like(m.word), np.zeros_like(m.word_bias)

        def step(rows, d_word, d_bias):
            word[rows] += d_word
            bias[rows] += d_bias

        g, (at, rows), _, loss = gru.gradients(m, h, ids, start, real, m.class_of, step)
        emb = np.zeros_like(m.emb)
        emb[at] = rows
        return g | {"emb": emb, "word": word, "word_bias": bias}, loss

    g = found()[0]
    for name in ("emb", "into", "rec", "bias", "grp", "grp_bias", "cls", "cls_bias", "word", "word_bias"):
        weights = getattr(m, name)
        for at in (np.unravel_index(i, weights.shape) for i in np.argsort(-np.abs(g[name]).ravel())[:3]):
            weights[at] += 1e-3
            up = found()[1]
            weights[at] -= 2e-3
            down = found()[1]
            weights[at] += 1e-3
            assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=1e-4), name
    docs = [rng.integers(0, 96, n).astype(np.uint16) for n in (400, 1, 17, 0, 17)]
    m = small_model()
    for steps in (3, 64):
        got = gru.score(m, docs, steps)
        for d, s in zip(docs, got, strict=True):
            state, total = np.zeros((1, 8), np.float32), 0.0
            for t in d.astype(int):
                total += gru.log_probs(m, state, np.array([t]))[0]
                state = gru.advance(m, state, np.array([t]))
            assert s == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_language_model_learns_what_follows():
    """Words alternate between two sets: knowing the last word halves the choice."""
    rng = np.random.default_rng(7)
    docs = [np.column_stack([rng.integers(0, 20, 30), rng.integers(20, 40, 30)]).ravel().astype(np.uint16) for _ in range(300)]
    m = gru.fresh(np.ones(40), np.zeros(2), 16, 8)
    before = gru.score(m, docs[:50]).sum()
    for rate in (0.02, 0.01, 0.005):
        m, n = gru.train(m, docs, rate)
    after = gru.score(m, docs[:50]).sum()
    assert n == 300 * 60 and (after - before) / (50 * 60) > 0.8 * np.log(2)


def test_tails_are_a_distribution():
    assert all(0 <= lm.tail_of(w) < gru.TAILS for w in (b"a", b"\xff\xff", b" ", b"word"))
    codes = lm.Codes()
    found, n, hashes, tails = codes.read(["A b", None, "b  a\n"])
    assert n.tolist() == [3, 1, 3] and found.tolist() == [0, 1, 2, 2, 1, 0, 2] and len(hashes) == len(tails) == 3


def test_scores(spark, empty):
    rng = random.Random(5)
    halves = [[f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]]
    rows = [(i, " ".join(rng.choice(halves[i % 2]) for _ in range(80)) + f" rare{i}") for i in range(400)] + [(500, None), (None, "a1 a2"), (1, "a1 B1"), (1, "a1 B1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 0
    got = lm.score_documents(df, learn, head=50).collect()
    tok = {r: [*(r[1] or "").lower().split(), "\n"] for r in rows}
    c = Counter(t for r in rows if (r[0] or 0) % 5 for t in tok[r])
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], len(tok[r]), sum(c[t] > 0 for t in tok[r]), round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tok[r]), 6)) for r in rows)
    assert Counter((r.k_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score_documents(empty, F.lit(True)).count() == 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    item = [[f"q{rng.randrange(900)}" for _ in range(n)] for n in (15, 30, 59, 90, 3)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(item)] + [(9, None)], "item_id long, text string")
    around = lambda n: [f"w{rng.randrange(600)}" for _ in range(n)]
    loose = [w if k % 6 else "other" for k, w in enumerate(item[1])]
    rows = [(1, around(200) + item[0] + around(90)), (2, around(17) + [w.upper() for w in item[1]]), (3, item[2] + around(400)), (4, around(33) + item[3]), (5, around(70) + loose + around(10)), (6, around(500)), (7, around(40) + item[2][:12] + around(60)), (8, around(8) + item[4])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(9, None), (10, "")], "doc_id long, text string")
    found = {(r.k_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert found == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 1), (8, 4)}  # item 4 has three words
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == {6, 7, 9, 10}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_finds_long_items(spark):
    rng = random.Random(19)
    some = lambda c, n: [f"{c}{rng.randrange(3000)}" for _ in range(n)]
    sizes = (65, 150, 200, 214, 400, 1_000)
    items = [some("q", n) for n in sizes]
    rows, want = [], set()
    for i, item in enumerate(items):
        loose = [w for k, w in enumerate(item) if k % 9 for w in ((w, "added", "more") if k % 5 == 0 else ("other",) if k % 7 == 0 else (w,))]
        for text in (item, loose):
            want.add((len(rows), i))
            rows.append((len(rows), " ".join(some("w", rng.randrange(300)) + text + some("w", rng.randrange(300)))))
        rows.append((len(rows), " ".join(some("w", 50) + item[: len(item) // 2] + some("w", 500))))  # half an item
        rows.append((len(rows), " ".join(rng.sample(item, len(item)))))  # its words in another order
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.k_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(found) == want
    assert all(found[4 * i, i].lcs == n for i, n in enumerate(sizes))


def exhaustive(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """Every item against every passage of every text, without a latent space."""
    out = set()
    for d, text in docs:
        w = decontaminate.words_of(text)
        for k, item in items:
            q = decontaminate.words_of(item)
            tail = q[len(q) - max(1, int(len(q) * decontaminate.ANSWER_PART)) :]
            for lo in range(0, len(w), 16):
                part = w[lo : lo + 128]
                if len(set(q) & set(part)) < 0.3 * len(set(q)):
                    continue
                number = {x: i for i, x in enumerate({*q, *part})}
                lcs, answer = (decontaminate._long_common(np.array([number[x] for x in y]), np.array([number[x] for x in part])) / len(y) for y in (q, tail))
                if lcs >= decontaminate.SURE or lcs >= decontaminate.LIKELY and answer >= decontaminate.ANSWER:
                    out.add((d, k))
    return out


def test_decontamination_of_many_items(spark, monkeypatch):
    """More items than a block holds, against the search of all passages; recall and precision of paraphrases."""
    rng = random.Random(11)
    common = [f"c{k}" for k in range(300)]
    some = lambda c, n: [rng.choice(common) if rng.random() < 0.5 else f"{c}{rng.randrange(4_000)}" for _ in range(n)]
    items = [(k, " ".join(some("q", rng.randrange(12, 60)))) for k in range(700)] + [(700, "two words"), (701, "solo"), (702, "two words"), (703, "...")]
    docs = []
    for d in range(260):
        text = some("w", rng.randrange(20, 200))
        if d % 2 == 0:
            words = [w for w in items[rng.randrange(700)][1].split() if rng.random() > rng.choice((0, 0.1, 0.2, 0.3))]
            at = rng.randrange(len(text))
            text[at:at] = words
        docs.append((d, " ".join(text)))
    docs += [(500, "we say Two, words"), (501, "two more words"), (502, "all SOLO!")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    monkeypatch.setattr(decontaminate, "KEPT_BLOCKS", 1)
    found = {(r.k_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert {f for f in found if f[1] >= 700} == {(500, 700), (500, 702), (502, 701)}
    found = {f for f in found if f[1] < 700}
    want = exhaustive(docs[:260], items[:700])
    assert len(want) > 90 and len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.03 * len(found)


def test_common_words():
    rng = random.Random(3)
    ids = [np.array([rng.randrange(12) for _ in range(n)]) for n in (5, 40, 64, 80)]
    items = decontaminate.Items(ids, 12)
    term = np.array([rng.randrange(12) for _ in range(300)])
    for _ in range(60):
        k, lo = rng.randrange(4), rng.randrange(250)
        hi = lo + rng.randrange(50)
        a, b = ids[k].tolist(), term[lo:hi].tolist()
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert items.common(np.array([k]), term, np.array([lo]), np.array([hi]))[0] == best[-1][-1]


def test_warc_round_trip(spark):
    long = "<p>" + "ü\r\n\r\nWARC/1.1\r\n" * 300
    rows = [(1, "http://a.example/x?q=1#f", long), (2, "http://b.example/", long), (3, None, long), (4, "http://a.example/x y\r\n", "short"), (5, "http://c.example", "short"), (6, "x", None), (7, "http://a.example/x?q=1", ""), (2, "http://b.example/", long), (None, "http://a.example", "no id")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    rows += [(2**63 - 1 - k, "http://late.example/", f"<p>{k}") for k in range(3)] + [(-(2**62), "http://late.example/", "before")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = warc.table_path(spark, "warc-test")
    files = warc.write_archives(pages, path, file_records=2)
    assert files.agg(F.sum("records")).first()[0] == len(rows) and files.count() > 5
    for fan_in, size in ((64, 100_000), (3, 4)):  # one level and range; several
        index = warc.merged_index(warc.read_runs(files, path), path, fan_in, size)
        got = index.collect()
        assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter(
            (i, len((h or "").encode()), "revisit" if h == long and i != 3 else "response", 3 if h == long and i != 3 else None) for i, _, h in rows
        )
        order = [(r.url_key, r.ts) for r in got]
        assert order == sorted(order) and got[-1].url_key != "" and all(len(r.ts) == 20 for r in got)
    assert sum(r.url_key == "example,a)/x?q=1" for r in got) == 2
    for r in got:  # offset and length find the record
        headers, block = warc.read_record(r.file, r.place, r.length)
        assert headers["warc-payload-digest"] == "sha1:" + r.payload_digest and warc.url_key(headers.get("warc-target-uri")) == r.url_key
    none = warc.write_archives(pages.limit(0), path)
    assert none.count() == 0 and warc.merged_index(warc.read_runs(none, path), path).count() == 0


def test_members_of_a_stream():
    import gzip

    parts = [b"", b"abc" * 50_000, random.Random(1).randbytes(200_000), b"x"]
    raw = [gzip.compress(p) for p in parts]
    found = list(warc.members(io.BytesIO(b"".join(raw)), 1_000))
    assert [f[0] for f in found] == parts and [f[2] for f in found] == [len(r) for r in raw] and found[2][1] == len(raw[0]) + len(raw[1])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(io.BytesIO(raw[1][:-5])))


def test_loser_tree():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.merge_runs(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><header><h2>The site</h2></header>
<div class="sidebar"><p>Popular today {i}</p></div><div class="post-content"><h1>Title &amp; more {i}</h1><p class="b1">By our staff writer</p>
<p>{a}<p>{b}&nbsp;end<br>line</p><form><label>mail</label><input></form><div class="share-links">Share</div></div>
<div id="comments"><p>Reader {i} says hi</p></div><div class="x9">Please accept everything</div><footer>Foot</footer></body>"""


def test_html(spark):
    words = lambda i, c: " ".join(f"{c}{i}x{k}" for k in range(40))
    rows = [(i, f"http://www.site.example/{i}", PAGE.format(i=i, a=words(i, "a"), b=words(i, "b"))) for i in range(9)]
    rows += [(20, "http://other.example", "<p>alone <b>text"), (21, None, None), (22, "bad url", ""), (23, "http://site.example", "no tags at all <"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract_text(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    text = {r.page_id: r.text for r in got}
    for i in range(9):
        assert text[i] == f"Title & more {i}\n{words(i, 'a')}\n{words(i, 'b')} end line"
    assert (text[20], text[21], text[22], text[23]) == ("alone text", "", "", "no tags at all <")
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_tree_matching():
    forms = html_extract.Forms()

    def shape(tree: tuple) -> int:
        return forms.shape(tree[0], tuple(shape(t) for t in tree[1]))

    a = shape(("body", (("nav", ()), ("p", ()), ("div", (("p", ()),)))))
    b = shape(("body", (("p", ()), ("div", (("p", ()), ("ul", ()))), ("footer", ()))))
    assert forms.match(a, b) == (4, ((1, 0), (2, 1))) and forms.match(a, a)[0] == 5


def plain_page(rng: random.Random, words: int) -> tuple[str, str]:
    """A page whose tags and classes say nothing, and its article."""
    some = lambda n: " ".join(f"x{rng.randrange(9_000)}" for _ in range(n))
    title, texts = some(6), [some(max(1, words // 4)) for _ in range(rng.randrange(2, 6))]
    items = [some(3) for _ in range(3)]
    links = "".join(f'<li><a href="/{k}">{some(2)}</a></li>' for k in range(5))
    body = f"<h1>{title}</h1>" + "".join(f"<p>{t}</p>" for t in texts) + "<ul>" + "".join(f"<li><a href=x>{t}</a></li>" for t in items) + "</ul><p>Share this page with all</p>"
    page = f"<body><div><ul>{links}</ul></div><div>{some(rng.randrange(4, 12))}</div><div>{body}</div><div>&copy; us {some(rng.randrange(5, 15))}</div></body>"
    return page, "\n".join([title, *texts, *items])


def test_alignment_decides_where_tags_say_nothing(monkeypatch):
    rng = random.Random(4)
    pages = [plain_page(rng, rng.choice((12, 40, 300))) for _ in range(32)]
    html, want = [p for p, _ in pages], [w for _, w in pages]
    assert html_extract.texts_of(html) == want
    monkeypatch.setattr(html_extract, "CONSTANT_PAGES", 1_000)  # every page alone
    found = html_extract.texts_of(html)
    assert sum(f != w for f, w in zip(found, want, strict=True)) > 20


def test_pages_of_two_kinds_share_a_host():
    rng = random.Random(6)
    pages = [plain_page(rng, 200) for _ in range(16)]
    words = lambda n: " ".join(f"y{rng.randrange(9_000)}" for _ in range(n))
    for _ in range(8):
        head, lead, text = words(5), words(20), words(150)
        page = f"<table><tr><td>{words(3)}</td><td><section><h1>{head}</h1><p>{lead}</p><section><p>{text}</p></section></section></td></tr></table><div>{words(4)}</div>"
        pages.append((page, f"{head}\n{lead}\n{text}"))
    pages.append(("<p>only one of its kind", "only one of its kind"))
    rng.shuffle(pages)
    assert html_extract.texts_of([p for p, _ in pages]) == [w for _, w in pages]


def test_odd_pages():
    deep = "<div>" * 100_000 + "at the bottom"
    assert html_extract.texts_of([deep]) == ["at the bottom"]
    deep = "<div>" * 10_000 + "at the bottom"
    assert html_extract.texts_of([deep + f" {k}" for k in range(6)]) == [f"at the bottom {k}" for k in range(6)]
    assert html_extract.texts_of(["<p>a<script>var x;", "<p>b<style>p{", "<p>c<svg><g>d", "<p>e<!-- f"]) == ["a", "b", "cd", "e"]
    assert html_extract.texts_of(["<article><p>text<ul><li><a href=x>one two three</a></ul></article><nav>menu</nav>"]) == ["text\none two three"]
    wide = lambda n: "".join(f"<p>{n} {k}<b>x</b></p><h{1 + k % 3}>y {k} {n}</h{1 + k % 3}>" for k in range(3_000))
    found = html_extract.texts_of([wide(n) + "<h2>end</h2>" * (n % 3) for n in range(6)])
    assert [f.count("\n") for f in found] == [5_999 + n % 3 for n in range(6)]
    assert html_extract.texts_of(["", None, "<", "<>", "</p></div>", "&amp;&lt;b&gt;"]) == ["", "", "<", "<>", "", "&<b>"]
    assert html_extract.texts_of(["same text of a copied page"] * 9) == ["same text of a copied page"] * 9


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    body = lambda n: " ".join(f"word{rng.randrange(5000)}" for _ in range(n))
    item, copied = body(25), body(150)
    rows = [(i, body(60), "en", f"s{i % 3}", 400) for i in range(40)] + [(50, copied, "en", "s0", 1), (51, copied, "en", "s1", 1), (52, copied + " one more", "en", "s2", 1), (53, body(40) + " " + item, "en", "s0", 1), (54, "too short", "en", "s0", 1), (55, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] == {*range(40), 50, 51, 52, 53} and kept[1] == {*range(40), 50, 53} and kept[2] == {*range(40), 50}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"shard", "slot", "grown_shard"} <= set(out.columns) and {r.doc_id for r in out.select("doc_id").collect()} <= kept[2]


def test_pipeline_links_documents_from_80_percent_on(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows, want = [], set()
    for i in range(60):  # texts of 204 words have 200 shingles; a word changed far from others takes 5 of them
        text = [f"word{rng.randrange(5000)}" for _ in range(204)]
        near = [f"new{i}x{k}" if k % 20 == 10 and k < 20 * (4 if i % 2 else 5) else w for k, w in enumerate(text)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(near))]
        want |= {2 * i} if i % 2 else {2 * i, 2 * i + 1}  # 180 of 220 are 0.82, 175 of 225 are 0.78
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()} == want


def test_archive_parser_rejects_broken_files():
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))

"""Main text of web pages by wrapper induction over pages of one host.

Pages of a host are dealt into buckets of about ``BUCKET``.  In a bucket, the block trees of the pages are aligned with
one page's tree by simple tree matching; runs of alike siblings (paragraphs, list items) count as one node.  What the
aligned pages have in common decides:

* A node whose text is the same on most pages while the articles differ is template and goes.
* What varies are slots.  From the page's root down, the slot that holds ``ROOT_SHARE`` of the words that vary and are
  no links, counted over all aligned pages, is followed as long as there is one; where that ends is the article.  Beside the
  way, headings and paragraphs stay, and other slots with ``SIDE_SHARE`` of the way's words; the rest goes.

Pages that do not have that way are aligned anew among themselves.  A page without enough fellows is judged alone, by its
own words and by an article or main element if it has one.  Elements whose name, class, id or role says menu, header, footer,
sidebar, notice, advert, form or comments are left out, but inside an article that the alignment has found, a class or id that
says so is believed of adverts and comments alone; of other things only where most words are links.

A null or empty html gives an empty text; a null URL or one without a host shares the host "".  Unclosed and
misnested tags are repaired as browsers do for paragraphs, list items and table cells; an unclosed script or style reaches
to the page's end.  Nothing recurses, so tags may nest to any depth.  Ties between slots go to the first.  Repeated rows
give repeated results; an empty table an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import copied_if_small, materialize, table

BUCKET = 32
#: A text on this share of a node's pages, of which there are at least so many, is template.
CONSTANT_SHARE, CONSTANT_PAGES = 0.7, 4
ROOT_SHARE, SIDE_SHARE = 0.7, 0.2
#: Two nodes with more pairs of unlike children than this are matched by the children's labels in turn.
MOST_PAIRS = 250_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[a-zA-Z/])[^>]*\Z|[^<]+|<",
    re.S,
)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed sets of HTML element names.
_RAW = frozenset("script style textarea title noscript template svg iframe object select xmp noembed noframes".split())
_TO_END = frozenset("script style textarea title iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SHUT = frozenset("nav footer aside form menu dialog button head fieldset video audio canvas".split())
_ENDS_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "li", "dt", "dd"} | {"li", "dt", "dd"}
_P, _NOT_P = frozenset({"p"}), _BLOCK - {"p"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_FENCE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
_WAY = frozenset("body html div section article main center table tbody tr td th".split())
_TEXT_LEVEL = frozenset("# p h1 h2 h3 h4 h5 h6 hgroup blockquote pre ul ol dl figure".split())
# Words in classes, ids and roles that say what an element is.
_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar "
    "header masthead topbar footer colophon copyright sidebar aside rail complementary contentinfo "
    "notice notices cookie cookies consent gdpr alert popup modal overlay paywall disclaimer "
    "subscribe subscription newsletter signup login search searchbox form "
    "comment comments commentlist disqus respond reply replies discussion "
    "related recommended recommendations share sharing social widget widgets skip hidden".split()
)
# Those of them that say so inside an article, too.
_HARD = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments commentlist disqus respond".split())
_IN = frozenset("content article post entry story main text body prose page".split())


class Node:
    __slots__ = ("children", "hard", "label", "linked", "out", "parts", "shape", "tag", "text", "up", "value", "words")

    def __init__(self, tag: str, label: str, out: int, up: Node | None):
        self.tag, self.label, self.out, self.up, self.hard = tag, label, out, up, True
        self.children: list[Node] = []
        self.text: str | None = None  # of a leaf, one block
        self.words = self.linked = 0


def _open(tag: str, attrs: str, up: Node) -> Node:
    label, out = tag, 2 if tag in _SHUT else 0
    hard = out or tag == "header"
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                out = hard = 2
                continue
            parts = {p.lower() for p in _PART.findall(value)}
            label += f" {name}={re.sub(r'[0-9]+', '#', value)}"
            if parts & _OUT:
                out = max(out, 1 if parts & _IN else 2)
                hard = hard or parts & _HARD
    if tag == "header":
        out = max(out, 1)
    node = Node(tag, label, out, up)
    node.hard = bool(hard)
    return node


def parse(text: str) -> list[Node]:
    """The page's block elements in document order, the root first; runs of inline text are leaves."""
    root = at = Node("body", "body", 0, None)
    nodes, inline = [root], []
    linked = in_link = 0
    skip, unclosed, opened = "", set(), Counter()

    def flush() -> None:
        nonlocal linked
        if inline:
            block = " ".join("".join(inline).split())
            if block:
                leaf = Node("#", "#", 0, at)
                leaf.text, leaf.words, leaf.linked = block, block.count(" ") + 1, min(linked, block.count(" ") + 1)
                at.children.append(leaf)
                nodes.append(leaf)
            inline.clear()
        linked = 0

    def close(tags, fence=()) -> None:
        nonlocal at
        if not any(opened[t] for t in tags):
            return
        node = at
        while node is not root and node.tag not in fence:
            if node.tag in tags:
                while at is not node.up:
                    opened[at.tag] -= 1
                    at = at.up
                return
            node = node.up

    for m in _TOKEN.finditer(text):
        token, tag = m[0], (m[2] or "").lower()
        if skip:
            if tag == skip and m[1]:
                skip = ""
            continue
        if not tag:
            if token[0] != "<" or token == "<":
                if "&" in token:
                    token = html_lib.unescape(token)
                inline.append(token)
                if in_link:
                    linked += len(token.split())
            continue
        if m[1]:
            if tag in _BLOCK or tag in _SHUT:
                flush()
                if tag not in ("body", "html"):
                    close({tag})
                in_link = 0
            elif tag == "a":
                in_link = 0
            continue
        if tag in _RAW:
            if not m[3].endswith("/") and tag not in unclosed:
                if re.compile(rf"</{re.escape(tag)}\b", re.I).search(text, m.end()):
                    skip = tag
                elif tag in _TO_END:
                    break
                else:
                    unclosed.add(tag)
            continue
        if tag == "br":
            inline.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in _BLOCK or tag in _SHUT:
            flush()
            in_link = 0
            if tag in ("html", "body", "hr"):
                continue
            if tag in _ENDS_P:
                close(_P, _NOT_P)
            if tag in _SAME:
                close(_SAME[tag], _FENCE[tag])
            node = _open(tag, m[3], at)
            at.children.append(node)
            nodes.append(node)
            if tag not in _VOID:
                at = node
                opened[tag] += 1
    flush()
    return nodes


class Forms:
    """Numbers for labels, folded shapes and texts that are alike in a bucket's pages."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.shapes: list[tuple[str, tuple[int, ...], int]] = []  # label, parts, size
        self.memo: dict[tuple[int, int], tuple[int, tuple]] = {}

    def _of(self, key: tuple) -> int:
        return self.number.setdefault(key, len(self.number))

    def shape(self, label: str, parts: tuple[int, ...]) -> int:
        key = ("shape", label, parts)
        if key not in self.number:
            self.number[key] = len(self.shapes)
            self.shapes.append((label, parts, 1 + sum(self.shapes[p][2] for p in parts)))
        return self.number[key]

    def measure(self, nodes: list[Node]) -> None:
        """Each node's words, shape and text, from the last node to the first; what is surely no article counts nothing."""
        for node in reversed(nodes):
            if node.text is not None:
                node.shape, node.parts, node.value = self.shape("#", ()), [], self._of(("text", node.text))
                continue
            node.parts = []
            for c in node.children:
                if c.out < 2:
                    node.words += c.words
                    node.linked += c.linked
                if node.parts and node.parts[-1][0].shape == c.shape:
                    node.parts[-1].append(c)
                else:
                    node.parts.append([c])
            node.shape = self.shape(node.label, tuple(p[0].shape for p in node.parts))
            node.value = self._of(("texts", tuple(c.value for c in node.children)))

    def match(self, a: int, b: int) -> tuple[int, tuple]:
        """Simple tree matching of two shapes: the number of matched nodes and the matched pairs of parts."""
        todo, memo = [(a, b)], self.memo
        while todo:
            i, j = todo[-1]
            if (i, j) in memo:
                todo.pop()
                continue
            x, y = self.shapes[i], self.shapes[j]
            if x[0] != y[0]:
                memo[i, j] = (0, ())
            elif i == j:
                memo[i, j] = (x[2], tuple((k, k) for k in range(len(x[1]))))
            elif need := [(p, q) for p, q in self._pairs(x[1], y[1]) if (p, q) not in memo]:
                todo += need
                continue
            else:
                memo[i, j] = self._aligned(x[1], y[1])
            todo.pop()
        return memo[a, b]

    def _ends(self, x: tuple, y: tuple) -> tuple[int, int]:
        """How many parts at the start, and how many at the end, are equal."""
        n = min(len(x), len(y))
        head = next((k for k in range(n) if x[k] != y[k]), n)
        tail = next((k for k in range(n - head) if x[-1 - k] != y[-1 - k]), n - head)
        return head, tail

    def _pairs(self, x: tuple, y: tuple) -> list[tuple[int, int]]:
        head, tail = self._ends(x, y)
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        if len(x) * len(y) > MOST_PAIRS:
            return [(x[i], y[j]) for i, j in self._in_turn(x, y)]
        label = lambda k: self.shapes[k][0]
        return list({(p, q) for p in x for q in y if label(p) == label(q)})

    def _in_turn(self, x: tuple, y: tuple) -> list[tuple[int, int]]:
        """Each part with the next one of its label."""
        places: dict[str, list[int]] = {}
        for j, q in enumerate(y):
            places.setdefault(self.shapes[q][0], []).append(j)
        out, after = [], 0
        for i, p in enumerate(x):
            where = places.get(self.shapes[p][0], ())
            k = bisect_left(where, after)
            if k < len(where):
                out.append((i, where[k]))
                after = where[k] + 1
        return out

    def _aligned(self, x: tuple, y: tuple) -> tuple[int, tuple]:
        head, tail = self._ends(x, y)
        pairs = [(k, k) for k in range(head)] + [(len(x) - 1 - k, len(y) - 1 - k) for k in range(tail)]
        x_, y_ = x[head : len(x) - tail], y[head : len(y) - tail]
        if len(x_) * len(y_) > MOST_PAIRS:
            pairs += [(i + head, j + head) for i, j in self._in_turn(x_, y_)]
        else:
            of = lambda p, q: self.memo[p, q][0] if self.shapes[p][0] == self.shapes[q][0] else 0
            best = [[0] * (len(y_) + 1) for _ in range(len(x_) + 1)]
            for i in range(1, len(x_) + 1):
                for j in range(1, len(y_) + 1):
                    best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + of(x_[i - 1], y_[j - 1]))
            i, j = len(x_), len(y_)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((i + head, j + head))
        size = lambda p, q: self.shapes[p][2] if p == q else self.memo[p, q][0]
        return 1 + sum(size(x[i], y[j]) for i, j in pairs), tuple(sorted(pairs))


class Wrapper:
    """What pages have in common with a template page's shape.  A place is a part of the template; place 0 is its root."""

    def __init__(self, forms: Forms, shape: int):
        self.forms, self.shape_at, self.inner = forms, [shape], {}
        self.pages: list[dict[int, list[Node]]] = []

    def add(self, page: Node) -> None:
        """Align a page: its nodes by the place that they match."""
        found, todo = {0: [page]}, [(page, 0)]
        while todo:
            node, place = todo.pop()
            parts = self.forms.shapes[self.shape_at[place]][1]
            if parts and place not in self.inner:
                self.inner[place] = range(len(self.shape_at), len(self.shape_at) + len(parts))
                self.shape_at += parts
            for i, j in self.forms.match(node.shape, self.shape_at[place])[1]:
                at = self.inner[place][j]
                found[at] = node.parts[i]
                if len(node.parts[i]) == 1 and node.parts[i][0].text is None:
                    todo.append((node.parts[i][0], at))
        self.pages.append(found)

    def way(self) -> tuple[list[int], dict[int, set[int]], set[int]]:
        """The places from the root to the article, those that stay beside each step, and the constant places."""
        words, linked, single, texts = Counter(), Counter(), Counter(), {}
        for found in self.pages:
            for p, nodes in found.items():
                single[p] += len(nodes) == 1
                texts.setdefault(p, Counter())[tuple(n.value for n in nodes)] += 1
                for n in nodes:
                    if n.out < 2:
                        words[p] += n.words
                        linked[p] += n.linked
        # text that is the same because the pages are copies of each other is no template
        different = len({found[0][0].value for found in self.pages})
        constant = set()
        for p, seen in texts.items():
            n, total = seen.most_common(1)[0][1], sum(seen.values())
            if p and n >= CONSTANT_PAGES and n >= CONSTANT_SHARE * total and 2 * different > n:
                constant.add(p)
        own = Counter({p: words[p] - linked[p] for p in words if p not in constant})
        steps, beside = [0], {}
        while True:
            at = steps[-1]
            inner = [p for p in self.inner.get(at, ()) if p in texts and p not in constant]
            label = lambda p: next((f[p][0] for f in self.pages if p in f), None)
            on = [p for p in inner if label(p).tag in _WAY and 2 * single[p] > len(self.pages)]
            best = max(on, key=lambda p: own[p], default=None)
            varying = sum(own[p] for p in inner)
            if best is None or not own[best] or own[best] < ROOT_SHARE * varying:
                return steps, beside, constant
            stays = lambda p: 2 * linked[p] < max(1, words[p]) and (label(p).tag in _TEXT_LEVEL or own[p] >= SIDE_SHARE * own[best])  # noqa: E731, B023
            beside[best] = {p for p in inner if p != best and stays(p)}
            steps.append(best)

    def gone(self, found: dict[int, list[Node]], steps: list[int], beside: dict[int, set[int]], constant: set[int]) -> set[int] | None:
        """The nodes of an aligned page that are no article; None if the page does not have the way."""
        if any(len(found.get(p, ())) != 1 for p in steps):
            return None
        out = set()
        for at, best in zip(steps, steps[1:], strict=False):
            main = found[best][0]
            stay = {id(n) for p in (best, *beside[best]) for n in found.get(p, ())}
            known = {id(n) for p in self.inner[at] for n in found.get(p, ())}
            for c in found[at][0].children:
                mine = c.tag in _TEXT_LEVEL or c.words - c.linked >= SIDE_SHARE * (main.words - main.linked)
                if id(c) not in stay and (id(c) in known or not (mine and 2 * c.linked < max(1, c.words))):
                    out.add(id(c))
        for p in constant & found.keys():
            common = Counter(tuple(n.value for n in f[p]) for f in self.pages if p in f).most_common(1)[0][0]
            if tuple(n.value for n in found[p]) == common:
                out.update(map(id, found[p]))
        return out


def _explicit(page: Node) -> list[Node]:
    """The outermost article or main elements that hold text, unless they are a small part of the page."""
    out, todo = [], [page]
    while todo:
        node = todo.pop()
        if node.out == 2 or node.text is not None:
            continue
        if node.tag in ("article", "main") or "role=main" in node.label or "role=article" in node.label:
            if node.words:
                inner = _explicit_inside(node)
                out.append(inner or node)
            continue
        todo.extend(reversed(node.children))
    return out if sum(n.words for n in out) >= 0.3 * page.words else []


def _explicit_inside(main: Node) -> Node | None:
    """A single article element that holds most of a main element."""
    if main.tag == "article":
        return None
    inside = [c for c in main.children if c.tag == "article" and c.out < 2]
    return inside[0] if len(inside) == 1 and inside[0].words >= 0.5 * main.words else None


def alone(page: Node) -> list[Node]:
    """The containers that hold the article of a page without fellows."""
    if found := _explicit(page):
        return found
    node = page
    while True:
        inner = [c for c in node.children if c.text is None and c.out < 2 and c.tag in _WAY]
        best = max(inner, key=lambda c: c.words - c.linked, default=None)
        if best is None or best.words - best.linked < ROOT_SHARE * (node.words - node.linked) or best.words == best.linked:
            return [node]
        rest = [c for c in node.children if c is not best and c.out < 2 and 2 * c.linked < c.words]
        if any(c.tag in _TEXT_LEVEL or c.words >= SIDE_SHARE * best.words for c in rest):
            return [node]
        node = best


def blocks(tops: list[Node], gone: set[int], total: int, article: Node | None = None) -> str:
    """The text below ``tops`` in page order, without what is gone or says that it is no article.

    Below ``article``, which fellows have told, what only says so stays unless most of its words are links.
    """
    out: list[str] = []
    todo = [(n, False, n is article) for n in reversed(tops)]
    while todo:
        node, heads, inside = todo.pop()
        if id(node) in gone and node not in tops:
            continue
        if node.text is not None:
            if not heads:
                out.append(node.text)
            continue
        told = node.hard or not inside or 2 * node.linked >= max(1, node.words)
        if node not in tops and told and (node.out == 2 or node.out == 1 and node.words < 0.5 * total):
            if node.out == 2 or node.tag != "header":
                continue
            heads = True  # a header's headings belong to the article that it heads
        elif heads and node.tag in ("h1", "h2", "h3"):
            heads = False
        todo += [(c, heads, inside or c is article) for c in reversed(node.children)]
    return "\n".join(out)


def texts_of(pages: list[str]) -> list[str]:
    """The main texts of pages of one host."""
    forms, trees = Forms(), []
    for p in pages:
        nodes = parse(p or "")
        forms.measure(nodes)
        trees.append(nodes[0])
    out: list[str | None] = [None] * len(trees)
    left = list(range(len(trees)))
    while len(left) >= CONSTANT_PAGES:
        wrapper = Wrapper(forms, Counter(trees[k].shape for k in left).most_common(1)[0][0])
        for k in left:
            wrapper.add(trees[k])
        way = wrapper.way()
        last = way[0][-1]
        of = dict(zip(left, wrapper.pages, strict=True))
        gone = {k: wrapper.gone(found, *way) for k, found in zip(left, wrapper.pages, strict=True)}
        fit = [k for k in left if gone[k] is not None]
        for k in fit:
            if len(fit) >= CONSTANT_PAGES:
                out[k] = blocks([trees[k]], gone[k], trees[k].words, of[k][last][0] if last else None)
            else:
                out[k] = blocks(alone(trees[k]), set(), trees[k].words)
        if not fit:
            break
        left = [k for k in left if gone[k] is None]
    for k in left:
        out[k] = blocks(alone(trees[k]), set(), trees[k].words)
    return out


def extract_text(pages: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(page_id, url, text)`` of ``pages(page_id, url, html)``."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    counts = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / bucket).alias("buckets")).withColumnRenamed("host", "c_host")
    counts = copied_if_small(materialize(counts, "hosts"), 80)
    dealt = rows.join(counts, F.col("host") == F.col("c_host")).withColumn("bucket", F.pmod(F.xxhash64("page_id", "url"), F.col("buckets")))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            texts = texts_of([r[2] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[3:] != place or len(held) >= 4 * bucket:
                    if held:
                        yield out(held)
                    place, held = row[3:], []
                held.append(row)
        if held:
            yield out(held)

    grouped = dealt.select("page_id", "url", "html", "host", "bucket").repartition("host", "bucket").sortWithinPartitions("host", "bucket", "page_id")
    return grouped.mapInArrow(run, f"page_id {kind}, url string, text string")


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))

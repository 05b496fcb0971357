"""Inside an article that aligned pages tell, names of classes and ids do not decide."""

from __future__ import annotations

import random

import pytest

from stationwise.llm import html_extract

WORDS = "river stone market engine winter copper garden signal harbour mirror forest candle bridge planet method theory sample result figure".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def page(k: int, kept: tuple[str, str, str] = ("discussion", "share-price", "related-work")) -> tuple[str, list[str]]:
    rng = random.Random(k)
    a, b, c, d, e = (prose(rng, 60 if i < 2 else 25) for i in range(5))
    links = "".join(f'<a href="/{i}">{prose(rng, 4)}</a> ' for i in range(9))
    html = f"""<html><body><div class="top"><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></div>
<div class="wrap"><div class="body"><h1>{a[:30]}</h1><p>{a}</p><div class="{kept[0]}"><p>{b}</p></div><p class="{kept[1]}">{c}</p>
<section id="{kept[2]}"><h2>Earlier work</h2><p>{d}</p></section><p>Where <math><mi>x</mi><mo>=</mo><mn>{k}</mn></math> holds, {e}</p>
<div class="comments"><p>{prose(rng, 20)}</p></div><div class="ad"><p>{prose(rng, 12)}</p></div><div class="related"><p>{links}</p></div>
<form><label>Mail</label><input></form><script>var x = "{e}"</script></div></div><div class="bottom"><p>All rights reserved by the makers of this site.</p></div></body></html>"""
    return html, [a[:30], a, b, c, "Earlier work", d, f"Where x={k} holds, {e}"]


def test_what_varies_inside_an_article_stays():
    pages = [page(k) for k in range(8)]
    for got, (_, want) in zip(html_extract.texts_of([html for html, _ in pages]), pages, strict=True):
        lines = got.split("\n")
        assert [x for x in lines if x not in want] == [] and [x.strip() for x in want if x not in lines and x != "Earlier work"] == []


def test_names_of_classes_do_not_change_an_article():
    plain = html_extract.texts_of([page(k, ("x1", "x2", "x3"))[0] for k in range(8)])
    assert html_extract.texts_of([page(k)[0] for k in range(8)]) == plain


@pytest.mark.parametrize("tag", ["nav", "aside", "footer", "form", "menu"])
def test_elements_that_are_no_article_go(tag):
    pages = [page(k)[0].replace('<div class="ad">', f"<{tag}>").replace("</p></div><div class=\"related\">", f"</p></{tag}><div class=\"related\">") for k in range(8)]
    want = [html_extract.texts_of([page(k)[0] for k in range(8)])]
    assert html_extract.texts_of(pages) == want[0]

"""Main text of pages: held-out pages, other layouts, the network's gradient, awkward pages."""

import html
import re

import numpy as np
import pytest
from cases import rows_of
from pyspark.sql import functions as F

from glossloom.llm import extraction
from glossloom.llm.blocks import blocks
from glossloom.llm.common import table
from glossloom.llm.layouts import Layout, pools

SF = "/root/testdata/sf0.1"
SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model(spark):
    return extraction.fit(table(spark, SF, "pages"))


def article(page):
    """What the given pages hold between the borders of their article element."""
    body = re.sub(r"<br>", " ", re.sub(r"</?b>", "", page[page.index("<article>") + 9 : page.index("</article>")]))
    return "\n".join(x for part in re.split(r"</?(?:p|h1)>", body) if (x := " ".join(html.unescape(part).split())))


def test_given_pages(spark, model):
    pages = table(spark, SF, "pages")
    learned = set(extraction.sample(pages, "html"))
    got = {r["page_id"]: r for r in rows_of(extraction.extract_pages(pages, model=model))}
    held = [r for r in pages.collect() if r["html"] not in learned]
    right = [got[r["page_id"]]["text"] == article(r["html"]) for r in held]
    assert len(held) > 1_000 and np.mean(right) > 0.995
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_other_layouts(spark, model):
    inside, outside = pools([blocks(r["html"]) for r in table(spark, SF, "pages").limit(60).collect()])
    made = [x for x in (Layout(np.random.default_rng(1_000 + i), inside, outside).page() for i in range(300)) if x[0]]
    found = extraction.chosen(model, [b for b, _ in made])
    same = [(id(b) in {id(x) for x in keep}) == bool(y) for (page, labels), keep in zip(made, found) for b, y in zip(page, labels)]
    assert np.mean(same) > 0.98


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><p>The Daily Site</p></header>
<div id="cookie-notice"><p>We use cookies to improve your experience.</p><button>Accept</button></div>
<nav><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul></nav>
<main><article><h1>A &lt;great&gt;  find</h1><p>First paragraph&nbsp;of the text, with <b>bold</b> and <a href="/x">a link</a>. It goes on for a while.
<p>Second paragraph, which is also part of the story.<div class="ad">Buy now and save 50%!</div><ul><li>One item of the list</li><li>Another item of it</li></ul>
<script>if (a < b) { document.write("</p>") }</script><p>Last words of the story.</p></article>
<section id="comments"><h3>2 comments</h3><ol class="comment-list"><li><p>Great post, thanks for sharing this with us all!</p></li></ol></section></main>
<aside class="sidebar"><h4>Related articles</h4><p>Another story that is not this one.</p></aside>
<form class="subscribe"><p>Enter your email address</p></form><footer><p>&copy; 2024 All rights reserved.</p></footer></body></html>"""


def test_a_page_with_every_kind_of_part(model):
    found = extraction.chosen(model, [blocks(PAGE)])[0]
    assert [b.text for b in found] == [
        "A <great> find", "First paragraph of the text, with bold and a link. It goes on for a while.", "Second paragraph, which is also part of the story.",
        "One item of the list", "Another item of it", "Last words of the story.",
    ]


def test_blocks_of_broken_pages():
    texts = lambda page: [b.text for b in blocks(page)]
    assert texts("<p>a<b>b</b> &amp c<br>d<p>e &lt;x> < f<ul><li>1<li>2</ul>tail") == ["ab & c d", "e <x> < f", "1", "2", "tail"]
    assert texts("") == texts("<div><p> </p>") == [] and texts("only text") == ["only text"]
    assert texts("<p title=\"a>b\">x</p><!-- <p>no</p> --><p>y<script>unclosed") == ["x", "y"]
    assert texts("<p title=\"never closed> x</p> y")[-1] == "y"
    assert len(blocks("<div>" * 20_000 + "x")[0].path) <= 32


def test_awkward_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", PAGE), (3, "u", PAGE), (4, "u", "<article>" + "<p>Some words of a text.</p>" * 3_000 + "</article>"), (5, "u", "\0<\x01 &#0; &bogus; &#xD800;")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("text", "n_chars", "score", "t"):
        df = df.withColumn(name, F.lit("clash"))
    got = rows_of(extraction.extract_pages(df, model=model))
    assert sorted(map(repr, (r["page_id"] for r in got))) == sorted(map(repr, (r[0] for r in rows)))
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[None] == "" and by[4].count("\n") == 2_999
    assert extraction.extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_gradient(monkeypatch):
    rng = np.random.default_rng(4)
    inside, outside = ["Some text of it.", "More of that text, with words."], ["Home", "About us"]
    made = [x for x in (Layout(rng, inside, outside).page() for _ in range(4)) if x[0]]
    bags, y = extraction.Bags([b[:12] for b, _ in made]), np.concatenate([y[:12] for _, y in made])
    shapes = ((extraction.PATHS, extraction.TAG), (extraction.PATHS, extraction.NAME), (extraction.WORDS, extraction.WORD))
    w = (extraction.INPUT + extraction.STATE + 1, 4 * extraction.STATE)
    params = [rng.normal(0, 0.3, s) for s in (*shapes, w, w, (2 * extraction.STATE + 1,))]

    class All:
        def random(self, n):
            return np.ones(n)

    def model(p):
        return extraction.Model(p[0], p[1], p[2], (p[3], p[4]), p[5])

    def loss(p):
        m = model(p)
        x = np.clip(extraction.probabilities(m, extraction.inputs(m, bags), bags.lengths).astype(float), 1e-7, 1 - 1e-7)
        return -np.mean(y * np.log(x) + (1 - y) * np.log(1 - x))

    grads = extraction._gradients(model(params), bags, y, All())
    for k in (0, 2, 3, 4, 5):
        at = np.unravel_index(np.argmax(np.abs(grads[k])), grads[k].shape)
        up, down = ([q.copy() for q in params] for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(grads[k][at], rel=0.05)

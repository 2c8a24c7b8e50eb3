"""Main text: the given pages against their template, held-out labelled pages, the chain's
sums and Viterbi against all labellings, the walk over broken markup, odd inputs."""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import html_extraction as he
from churnlens.llm import queries

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model(spark):
    return he.fit(he.labelled_pages(spark))


def template_text(page: str) -> str:
    """The article of the given pages' one template, by its own tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    out = []
    for part in re.split(r"</?h1>|</?p>", inner):
        part = " ".join("".join(html.unescape(x) for x in re.split(r"</?b>", part.replace("<br>", " "))).split())
        if part:
            out.append(part)
    return "\n".join(out)


def test_query_on_given_pages(spark):
    rows = queries.op12_html_main_text(spark, "/root/testdata/sf0.01").collect()
    given = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(given)
    for r in rows:
        assert r["text"] == template_text(given[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == given[r["page_id"]]["url"]


def test_held_out_pages(model):
    """Made by the same rule from other numbers: at least 97 % of main blocks found, as few wrong."""
    missed = wrong = total = 0
    for i in range(300):
        page = he._Maker(np.random.default_rng([99, i])).page()
        want = Counter(t for t in (b[0][1:].strip() for b in he.blocks(page) if b[0][0] == he.MAIN) if t)
        got = Counter(model.main_text(page.replace(he.MAIN, "").replace(he.REST, "")).split("\n"))
        got.pop("", None)
        missed, wrong, total = missed + sum((want - got).values()), wrong + sum((got - want).values()), total + sum(want.values())
    assert missed <= 0.03 * total and wrong <= 0.03 * total


def test_other_layouts(model):
    page = """<html><body class="home"><div id="top-nav"><a href=/a>Home</a> | <a href=/b>News</a></div>
    <div class="cookie-banner"><p>We use cookies to give you a better experience on this site, and you agree to them.</p></div>
    <div class="post-content"><h1>A title</h1><div class="byline">By Someone, today</div><p>First paragraph of the text, long enough to be read as one.</p>
    <div class="advertisement">Buy this now, it is cheap and good.</div><p>Second&nbsp;paragraph &lt;with&gt; a <a href=x>link</a> in it.<p>Third one, without an end
    <script>document.write("<p>no</p>")</script></div>
    <div class="comments"><h3>2 comments</h3><div class="comment"><p>I liked the whole of this very much, thank you for writing.</p></div></div>
    <form class="newsletter"><label>Mail</label><input><button>Go</button></form><div class="sidebar"><ul><li><a href=q>Other story</a></li></ul></div>
    <footer>&copy; 2024 A site</footer></body></html>"""
    assert model.main_text(page) == ("A title\nFirst paragraph of the text, long enough to be read as one.\nSecond paragraph <with> a link in it.\n"
                                     "Third one, without an end")


def test_walk():
    text = lambda p: [t for t, _, _ in he.blocks(p)]
    assert text("a<b>b</b> c<br>d<p>e &amp; f&am<p>g</p>") == ["ab c d", "e & f&am", "g"]
    assert text("<!-- <p>x --><p>a<!-- b -->c</p><script>'<p>no</p>'</script><style>p{}</style><title>t</title>d") == ["ac", "d"]
    assert text("<p title='a > b'>x<div data-q=\"</div>\">y</div>1 < 2 & 3 <4") == ["x", "y", "1 < 2 & 3 <4"]
    assert text("<p>cut <a href='/x") == ["cut"] and text("<script>never closed <p>x") == [] and text("a<!-- open") == ["a"]
    assert text("&#65;&#x42;&notit;&#0;") == ["AB¬it;�"] and text("") == [] and text(" \n\xa0<p></p> ") == []
    _, linked, node = he.blocks("<nav class='topMenu x'><ul><li><a href=q>ab</a> cd</li></ul></nav>")[0]
    assert linked == 2 and {"t:nav", "n:top", "n:menu", "t:li"} <= set(node.features()) and node.near == "ul"
    # <li> ends the one before, but not the one of an outer list
    assert [n.tag for _, _, n in he.blocks("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>f")] == ["li", "li", "li", "li", "li", ""]


def test_chain_and_viterbi_as_all_labellings():
    rng = np.random.default_rng(4)
    length = np.array([1, 4, 3])
    emit, start, step = rng.normal(size=(3, 4)), 0.3, rng.normal(size=(2, 2))
    total, main, pairs = he.chain(emit, length, start, step)
    want_pairs = np.zeros((2, 2))
    for p, n in enumerate(length):
        score = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            score[y] = start * y[0] + sum(emit[p, k] for k in range(n) if y[k]) + sum(step[a, b] for a, b in itertools.pairwise(y))
        z = sum(np.exp(s) for s in score.values())
        assert total[p] == pytest.approx(np.log(z))
        for k in range(n):
            assert main[p, k] == pytest.approx(sum(np.exp(s) for y, s in score.items() if y[k]) / z)
        for y, s in score.items():
            for a, b in itertools.pairwise(y):
                want_pairs[a, b] += np.exp(s) / z
    assert np.allclose(pairs, want_pairs)
    for _ in range(60):
        n = int(rng.integers(1, 6))
        weights = {f"n:q{chr(97 + k)}": float(rng.normal()) for k in range(n)}
        m = he.Model(weights, float(rng.normal()), rng.normal(size=(2, 2)).tolist())
        page = "".join(f"<div class='q{chr(97 + k)}'>t{k}</div>" for k in range(n))
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: m.start * y[0] + sum(w for w, on in zip(weights.values(), y, strict=True) if on)
                   + sum(m.step[a][b] for a, b in itertools.pairwise(y)))
        assert m.main_text(page) == "\n".join(f"t{k}" for k in range(n) if best[k])


def test_odd_input(spark, model):
    long = "<article>" + "<p>Some words of a long text, again and again.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<nav><a href=x>only</a></nav>"), (4, "u", long), (4, "u", long), (5, "u", "<" * 3000), (6, "u", "<p " * 3000),
            (7, "u", "<div>" * 5000 + "x" + "</div>" * 5000)]
    df = spark.createDataFrame(rows, PAGES)
    for c in ("text", "n_chars", "Score", "label"):
        df = df.withColumn(c, F.lit(1))
    got = he.extract(df, model).collect()
    assert len(got) == len(rows) and [c for c in got[0].asDict()] == ["page_id", "url", "text", "n_chars"]
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "" and by[2]["text"] == "" and by[None]["text"] == "" and by[1]["n_chars"] == 0
    assert by[4]["text"].count("\n") == 19_999 and by[4]["n_chars"] == len(by[4]["text"])
    assert he.extract(spark.createDataFrame([], PAGES), model).collect() == []


def test_labels_are_needed(spark):
    with pytest.raises(ValueError):
        he.train(["<p>no mark</p>"])
    same = [r["html"] for r in he.labelled_pages(spark, 6).orderBy("page_id").collect()]
    assert same == [r["html"] for r in he.labelled_pages(spark, 6).orderBy("page_id").collect()] and len(set(same)) == 6

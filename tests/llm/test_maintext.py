"""Main text: the cut against all labellings, blocks of odd markup, pages of several layouts."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lacuna.llm import maintext
from lacuna.llm.html_blocks import blocks_of

SCHEMA = StructType([
    StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType()),
    StructField("text", IntegerType()), StructField("n_chars", StringType()),
])
STORY = ["The council met on Tuesday, and it voted for the new bridge after a long debate.", "No one spoke.", "Work starts in May, said the mayor, once the river is low enough to build."]


def cost(label, score, edges):
    own = sum(-s if x and s < 0 else s if not x and s > 0 else 0 for x, s in zip(label, score, strict=True))
    return own + sum(c for a, b, c in edges if label[a] != label[b])


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_the_cheapest_labelling(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 10)
    score = [rng.randint(-9, 9) for _ in range(n)]
    edges = [(k - 1, k, rng.randint(0, 8)) for k in range(1, n)] + [(rng.randrange(n), rng.randrange(n), rng.randint(0, 6)) for _ in range(n)]
    costs = {label: cost(label, score, edges) for label in product([False, True], repeat=n)}
    got = tuple(maintext.minimum_cut(score, edges))
    assert costs[got] == min(costs.values())
    assert sum(got) == min(sum(x) for x, c in costs.items() if c == costs[got])


def test_cut_of_a_long_page():
    rng = random.Random(5)
    n = 30_000
    score = [rng.choice([-1, 1]) * rng.randint(0, 900) for _ in range(n)]
    edges = [(k - 1, k, 500) for k in range(1, n)] + [(k - 3, k, 300) for k in range(3, n, 2)]
    assert len(maintext.minimum_cut(score, edges)) == n


def texts(html):
    return [b.text for b in blocks_of(html)]


@pytest.mark.parametrize("html, want", [
    (None, []), ("", []), ("  <p> </p> ", []), ("plain &amp; simple", ["plain & simple"]),
    ("<p>a<p>b<div>c</p>d", ["a", "b", "c", "d"]),
    ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("<table><tr><td>a<td>b<tr><th>c</th><td><p>d</table>", ["a b", "c", "d"]),
    ("<p>a<b>b</b>c<br>d\n\t e</p>", ["abc d e"]),
    ("<p>x &lt;b&gt; &copy; &#65;&#x42; &nbsp;&eacute;&am</p>", ["x <b> © AB é&am"]),
    ("<script>if (a</p> && '<p>x') {}</script>y<style>p{}</STYLE >z", ["yz"]),
    ("a<!-- <p>b</p> -->c<![CDATA[x]]>d<?php echo ?>e<!doctype html>", ["acde"]),
    ("<p title='a>b' class=\"x\">c < d <3</p>", ["c < d <3"]),
    ("<p>a<a href=it's>b</a>c</p><p x=\"y>z", ["abc", "z"]),
    ("<head><title>t</title><p>a<body><p>b", ["a", "b"]),
    ("<p>a<button>no</button><select><option>no</select><svg><text>no</text></svg>b</p>", ["ab"]),
    ("<div hidden>x</div><div style='display : none'>x<p>y</div><i aria-hidden=true>z</i><p>a", ["a"]),
    ("<dl><dt>a<dd>b<dt>c</dl><script>never closed <p>x", ["a", "b", "c"]),
    ("</div></p><b><i>a</div>b", ["a", "b"]),
])
def test_blocks(html, want):
    assert texts(html) == want


def test_deep_and_wide_pages():
    assert texts("<div>" * 20_000 + "x" + "</div>" * 20_000) == ["x"]
    assert texts("<b>" * 20_000 + "<p>x" * 5000) == ["x"] * 5000
    assert len(texts("<li>a" * 20_000 + "<")) == 20_000
    assert len(texts("<p " + 'a="' * 20_001)) <= 1


LAYOUTS = {
    "article": "<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><article><h1>Bridge</h1>{}</article>"
    "<aside><p>Most read: a long list of stories, and more.</p></aside><footer>About us</footer>",
    "named": "<div id='top-nav'><a href=/>Home</a> <a href=/x>News</a></div><div class='post-content'><h2>Bridge</h2>{}</div>"
    "<div class='sidebar'><h3>More</h3><p>Another story, told in full here.</p></div><div id='footer'>© 2020 Us</div>",
    "comments": "<main><article class='post'><h1>Bridge</h1>{}<section id='comments'><article class='comment'><p>Great piece, I liked it a lot, thanks for writing."
    "</p></article><form><label>Your comment, please be kind.</label><textarea>x</textarea></form></section></article></main>",
    "advert inside": "<article><h1>Bridge</h1><div class='ad-slot'>Buy the best shoes now, only today, and save.</div>{}<footer>Filed under news</footer></article>"
    "<div class='cookie-notice'><p>We use cookies to make this site better. By staying, you agree.</p></div>",
    "one form": "<form id=aspnet><div class=header>Site</div><div class='has-sidebar'><div class='wrapper-with-nav'><article><h1>Bridge</h1>{}</article></div></div>"
    "<div class='newsletter'>Subscribe to our letter, it is free, and weekly.</div></form>",
    "part by name only": "<div class='sidebar-left-layout'><main><h1>Bridge</h1>{}</main></div><div class='popup'>Sign up, and get ten percent off your order.</div>",
    "bare": "<table><tr><td><a href=/>Home</a><td><a href=/a>News</a><td><a href=/b>Sport</a></table><h1>Bridge</h1>{}<p><a href=/p>Privacy</a> <a href=/t>Terms</a></p>",
}


@pytest.mark.parametrize("layout", list(LAYOUTS))
def test_layouts(layout):
    html = "<!DOCTYPE html><html><head><title>Bridge | Site</title><script>var a='<p>no</p>';</script></head><body class='nav-open'>"
    html += LAYOUTS[layout].format("".join(f"<p>{s}</p>" for s in STORY)) + "</body></html>"
    assert maintext.main_text(html).split("\n") == ["Bridge", *STORY]


def test_classifier(spark):
    assert (maintext.fitted(np.zeros((0, len(maintext.PRIOR))), np.zeros(0, bool)) == maintext.PRIOR).all()
    html = LAYOUTS["article"].format("".join(f"<p>{s}</p>" for s in STORY))
    pages = spark.createDataFrame([(k, "u", html + f"<!-- {k} -->", 1, "x") for k in range(40)], SCHEMA)
    w = maintext.learned(pages)
    assert not (w == maintext.PRIOR).all() and (w == maintext.learned(pages.repartition(7))).all()
    blocks = blocks_of(html)
    said = maintext.forms(blocks) @ w
    assert min(said[k] for k, b in enumerate(blocks) if b.text in (STORY[0], STORY[2])) > max(s for s, b in zip(said, blocks, strict=True) if b.linked == 1)


def test_odd_rows(spark):
    html = LAYOUTS["article"].format("<p>caf&eacute; \U0001d54f</p>")
    rows = [(1, "u", None), (2, None, ""), (None, "u", html), (3, "u", html), (3, "u", html), (4, "u", "<nav>only</nav>"), (5, "u", "<article>" + "<p>long text, here." * 5000)]
    pages = spark.createDataFrame([(i, u, h, 7, "z") for i, u, h in rows], SCHEMA)
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in maintext.extract(pages).collect()), key=repr)
    said = "Bridge\ncafé \U0001d54f"
    want = [(0, "u", said, 13), (1, "u", "", 0), (2, None, "", 0), (3, "u", said, 13), (3, "u", said, 13), (4, "u", "", 0)]
    assert got == sorted([*want, (5, "u", "\n".join(["long text, here."] * 5000), 17 * 5000 - 1)], key=repr)
    assert maintext.extract(pages.limit(0)).collect() == []

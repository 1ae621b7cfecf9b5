"""HTML extraction: the given pages by their own markup, built layouts, and odd pages."""

import html as references
import os
import random
import re

import numpy as np
import pytest

from leaksift.llm import boosting, html

SF = "/root/testdata/sf0.001"
PROSE = ("The council met on Tuesday evening to hear the plans for the old harbour, which many had long awaited. "
         "After two hours of questions, the members agreed to wait for the engineers' report before they vote.")


def inner(page):
    """Blocks of the page's article, for pages that hold nothing else in it."""
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<(?:b|/b|br)>", " ", body))
    return "\n".join(t for t in (" ".join(references.unescape(p).split()) for p in parts) if t)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: inner(r.html) for r in pages.collect()}
    out = html.main_text(pages).collect()
    assert len(out) == len(want) and all(r.n_chars == len(r.text) for r in out)
    assert sum(want[r.page_id] == r.text for r in out) >= 0.98 * len(out)


def test_layouts_not_seen_in_fitting():
    rng = random.Random(1)
    long = [" ".join(rng.choice(PROSE.split()) for _ in range(rng.randint(20, 120))) + "." for _ in range(60)]
    short = [" ".join(rng.choice(PROSE.split()) for _ in range(rng.randint(1, 8))) for _ in range(60)]

    def made(seed, n):
        r = random.Random(seed)
        return [html.Page(html._layout(r, long, short)) for _ in range(n)]

    rows, marks = [], []
    for page in made(5, 300):
        good, every = np.zeros(len(page.tag)), np.zeros(len(page.tag))
        for node, text, _ in page.blocks:
            every[node] += len(text)
            good[node] += len(text) * page.marked[node]
        for i in range(len(page.tag) - 1, 0, -1):
            good[page.parent[i]] += good[i]
            every[page.parent[i]] += every[i]
        rows.append(html.node_features(page)[every > 0])
        marks.append((good * 2 > every)[every > 0].astype(float))
    trees = boosting.boosted(np.concatenate(rows).astype(float), np.concatenate(marks), rounds=40)
    right = total = 0
    for page in made(99, 100):
        keep = html.decoded(page, trees.margin(html.node_features(page)))
        right += sum(page.marked[n] == k for (n, _, _), k in zip(page.blocks, keep))
        total += len(keep)
    assert right / total > 0.95


def test_parsing_of_odd_markup():
    blocks = lambda h: [t for _, t, _ in html.Page(h).blocks]
    assert blocks(None) == blocks("") == blocks("<!-- x -->") == []
    assert blocks("<p>a &amp; b<br>c&nbsp; d<p><b>e</p>f") == ["a & b c d", "e", "f"]
    assert blocks("<p>x<script>var a='</p><p>no';</script>y</p><style>p{}</style><title>t</title>") == ["xy"]
    assert blocks('<div title="a > b">1 < 2<ul><li>one<li>two</ul></div>three') == ["1 < 2", "one", "two", "three"]
    assert blocks("<p>cut off &quot;he") == ['cut off "he'] and blocks("<p>end <a hre") == ["end"]
    assert blocks("<select><option>no</select><p>yes<textarea>no</textarea></p></p>") == ["yes"]
    assert len(blocks("<div>" * 3000 + "deep")) == 1


@pytest.mark.parametrize("name", sorted(html.RAW))
def test_raw_elements_end_after_letters_that_grow_in_lower_case(name):
    blocks = [t for _, t, _ in html.Page(f"<body><p>{'İ' * 20}stanbul</p><{name}>x < İ</{name.upper()}><article>text İ</article><p>end</p></body>").blocks]
    assert blocks == ["İ" * 20 + "stanbul", "text İ", "end"]


SHOWN = ("style='overflow:hidden'", "aria-hidden=false", "class='hidden-print'", "data-state=hidden", 'title="hidden, style=\'display:none\'"',
         "style='overflow-x: hidden; color:red'", "style='backface-visibility:hidden'", "data-style='display:none'", "style='display:none-such'")
HIDDEN = ("hidden", "HIDDEN=''", "class=x hidden", "aria-hidden='True'", "aria-hidden=true", "style='display : none'", "style=display:none",
          'style="color:red; DISPLAY:none !important"', "style='visibility:hidden;'", 'id=a style="overflow:hidden;visibility: hidden"')


def test_only_what_is_hidden_counts_as_hidden():
    for attrs in SHOWN + HIDDEN:
        assert html.Page(f"<div {attrs}>text</div>").hidden == [False, attrs in HIDDEN], attrs
    for attrs in SHOWN:
        page = html.Page(f"<article><p>a</p><p {attrs}>b</p><div {attrs}><p>c</p></div></article>")
        assert html.decoded(page, np.full(len(page.tag), 3.0)) == [True] * 3, attrs
    rng = random.Random(2)
    made = "".join(html._layout(rng, [PROSE], ["short"]) for _ in range(100))
    assert all(s in made for s in html.SHOWN)


def test_decoding_is_consistent():
    page = html.Page("<div><p>a</p><p>b</p></div><section><p>c</p></section>")
    # The section is surely none of the article: its paragraph goes with it, whatever is said of it.
    odds = np.zeros(len(page.tag))
    for i, tag in enumerate(page.tag):
        odds[i] = {3: 4.0, 4: 1.0, 2: -5.0}.get(tag, -0.1)
    assert html.decoded(page, odds) == [True, True, False]


def test_rows_and_columns(spark):
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h1>Harbour</h1><p>{PROSE}</p><p>{PROSE[:90]}</p></article></body></html>"
    rows = [(1, "u", page, "old", 7), (1, "u", page, "old", 7), (2, None, None, "old", 7), (3, "u", "", "old", 7), (None, "u", page * 300, "old", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = html.main_text(pages).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == 5 and by[2].text == by[3].text == "" and by[2].n_chars == 0
    assert PROSE in by[1].text and "Home" not in by[1].text and by[None].n_chars == len(by[None].text)
    assert html.main_text(pages.limit(0)).count() == 0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = boosting.boosted(x[:1500], y[:1500])
    assert ((trees.margin(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95

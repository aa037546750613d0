from __future__ import annotations

import html
import re

import numpy as np
import pytest

from snipscan.llm import html_blocks as hb
from snipscan.llm.queries import QUERIES

P = "The quick brown fox goes over the lazy dog and then comes back again for a while."


def errors(tree, columns=None):
    """The share of the table's whole pages' blocks that a tree gets wrong, with only some features if ``columns`` says so."""
    wrong = total = 0
    for page, main in hb.PAGES:
        blocks, parts = hb.blocks_of(page)
        x = hb.describe(blocks, parts)
        if columns is not None:
            x[:, [c for c in range(x.shape[1]) if c not in columns]] = 0
        y = np.array([b.text in main for b in blocks])
        wrong, total = wrong + (tree.main(x) != y).sum(), total + len(y)
    return wrong / total


def test_tree_fits_its_table():
    assert errors(hb.trained()) < 0.01


@pytest.mark.parametrize("without", ["words link_density", "words_before links_before words_after links_after", "strong strong_share", "weak weak_share article"])
def test_each_kind_of_feature_changes_results(without):
    x, y = hb.table_rows()
    columns = [i for i, f in enumerate(hb.FEATURES) if f not in without.split()]
    x[:, [c for c in range(x.shape[1]) if c not in columns]] = 0
    assert errors(hb.grow(x, y), columns) > 1.2 * errors(hb.trained()) + 0.0005


def test_neighbours_decide_on_pages_without_names():
    foot = "Printed in the valley by us."
    page = "<div><a href=/>Home</a> <a href=/n>News</a></div>{}<h1>High water</h1><p>" + P + "</p><p>Yes.</p><p>" + P + " 2</p><div><a href=/a>Back to all</a> <a href=/b>Map</a></div><p>{}</p>"
    assert hb.main_text(page.format("", foot)) == f"High water\n{P}\nYes.\n{P} 2"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("<script>x", ""), ("<!-- x", ""),
    (f"<article><p>{P}</p><p> a &amp; b&nbsp;&lt;c&gt; \n\t d </p></article>", f"{P}\na & b <c> d"),
    (f"<body><nav><a href='/'>Home</a></nav><article><h1>T</h1><p>{P}<br>more</p></article><footer>{P}</footer></body>", f"T\n{P} more"),
    (f"<article><p>{P}</p><aside>{P} x</aside><form><p>{P} y</p></form><div class='cookie-banner'>{P} z</div><p>{P} end</p></article>", f"{P}\n{P} end"),
    (f"<body><div id='sidebar'><p>{P} s</p></div><main><p>{P}</p><div class=\"ads\">{P} ad</div></main><section id=comments><p>{P} c</p></section></body>", P),
    (f"<article><p>{P}</p></article><article class='comment'><p>{P} r</p></article><div class='cookieBanner'><p>{P} c</p></div><ol id=commentlist><li>{P} l</li></ol><div role=contentinfo>{P} f</div>", P),
    (f"<title>Site</title><article><button>{P} b</button><svg><p>{P}</p></article>", P),
    (f"<head><title>x</title><body><article><p>{P}</p><object><p>{P} o</p></article>", f"{P}\n{P} o"),
    (f"<article><p><b>{P}<i>bold</i></b></p></div></p></article>", f"{P}bold"),
    (f"<article><style>p{{}}</style><p>{P}</p><script>var t='</p>';</script><noscript>{P} no</noscript></article>", P),
    (f"<article><p>x &#233; &eacute; &#x1F600; {P}</p></article>", f"x é é 😀 {P}"),
])
def test_pages(page, text):
    assert hb.main_text(page) == text


def test_query_on_the_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = QUERIES["op6_html_blocks"](spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        body = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</p>|<br><p>|</h1>|<p>", body)]
        assert r.text == "\n".join(filter(None, parts)) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (3, "u", f"<p>{P}" * 5_000, "t"), (4, "u", "<" * 2_000 + "p class='" + "x" * 2_000, "t")], "page_id int, url string, html string, text string")
    out = hb.extract_text(df).collect()
    assert len(out) == 5 and next(r for r in out if r.page_id == 3)._text.count("\n") == 4_999
    assert hb.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper, kept", [
    ('<body style="overflow:hidden">{}</body>', True), ('<body class="overflow-x-hidden">{}</body>', True), ('<main aria-hidden="false">{}</main>', True), ('<div class="overflow-hidden">{}</div>', True),
    ('<div id="page" class="has-sidebar">{}</div>', True), ('<div class="post with-comments">{}</div>', True), ('<div class="sidebar-left">{}</div>', True), ('<html class="no-sidebar">{}</html>', True),
    ('<div hidden>{}</div>', False), ('<div aria-hidden="true">{}</div>', False), ('<div style="color:red; display: none">{}</div>', False), ('<div class="comments">{}</div>', False),
])
def test_wrappers_of_an_article(wrapper, kept):
    assert hb.main_text(wrapper.format(f"<article><p>{P}</p></article>")) == (P if kept else "")


@pytest.mark.parametrize("page, text", [
    (f'<article style="overflow: hidden"><h1 class="entry-header">T</h1><p class="discussion">{P}</p><p id="legal">{P} l</p></article>', f"T\n{P}\n{P} l"),
    (f'<div class="nav">x</div><article><p class="ad">Buy<p>text<p>{P}</p></article>', f"text\n{P}"),
    (f'<article><p>{P}</p><div class="ad">Buy two</div><p>Yes.</p><p><a href="/s">The source of it all</a></p></article>', f"{P}\nYes.\nThe source of it all"),
    (f'<nav><a href=/>Home</a></nav><article><p>Be.</p><p>No.</p></article><footer>f</footer>', "Be.\nNo."),
    (f'<article><ul><li>one<li>two<li><p>three</ul><table><tr><td>a<td>b<tr><td>{P}</table></article>', f"one\ntwo\nthree\na\nb\n{P}"),
    (f'<article><p>{P} <span style="display:none">secret</span>end</p><p hidden>h</p></article>', f"{P} end"),
    (f'<form id="aspnetForm"><main><p>{P}</p><form><p>{P} f</p></form></main></form>', P),
])
def test_no_text_of_an_article_is_lost(page, text):
    assert hb.main_text(page) == text


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, f"<p>{P}</p>", "mine")], "page_id int, html string, _text string")
    out = hb.extract_text(df)
    assert out.columns == ["page_id", "html", "_text", "__text"] and out.first()[2:] == ("mine", P)


def test_math_is_text():
    assert hb.main_text(f"<article><p>{P} <math><mi>x</mi><annotation>tex</annotation></math> end</p></article>") == f"{P} x end"

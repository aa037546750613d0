"""Pages by another hand than the labelled table's, and names that mislead."""

from __future__ import annotations

import pytest

from snipscan.llm import html_blocks as hb

P = "The quick brown fox goes over the lazy dog and then comes back again for a while."
Q = "Nobody in the village had ever seen so many boats at once, and most went down to the quay to count them."
R = "By noon there were forty, and the harbour master gave up writing their names into the large green book."


@pytest.mark.parametrize("name", "ad-free market-share share-price comment-free login-help social-policy article__promo related-work cookie-recipe menu-item profile-menu text-teaser discussion legal".split())
def test_a_paragraph_of_an_article_keeps_its_text(name):
    assert hb.main_text(f'<article><h1>Boats</h1><p>{P}</p><p class="{name}">{Q}</p><p>{R}</p></article>') == f"Boats\n{P}\n{Q}\n{R}"


@pytest.mark.parametrize("name", "market-share cookie-recipe related-work ad-free promo".split())
def test_a_section_of_the_page_keeps_its_text(name):
    assert hb.main_text(f'<main><h1>Boats</h1><p>{P}</p><section class="{name}"><h2>More boats</h2><p>{Q} {R}</p><p>{P} {R}</p></section></main>') == f"Boats\n{P}\nMore boats\n{Q} {R}\n{P} {R}"


@pytest.mark.parametrize("name", "ad ad-box cookie-banner share-buttons comments comment-list site-footer sidebar-left main-menu related-posts newsletter-signup breadcrumbs".split())
def test_parts_that_are_named_whole_go(name):
    extra = {"ad": "Buy now, half price!", "ad-box": "Best boats, book today."}.get(name, '<a href="/a">One thing</a> <a href="/b">Another thing</a>')
    assert hb.main_text(f'<body><div class="{name}"><p>{extra}</p></div><article><h1>Boats</h1><p>{P}</p><p>{Q}</p></article></body>') == f"Boats\n{P}\n{Q}"


@pytest.mark.parametrize("page, text", [
    (f'<body><form method="post" action="./Default.aspx" id="aspnetForm"><div id="wrap"><h1>Boats</h1><p>{P}</p><p>{Q}</p></div></form></body>', f"Boats\n{P}\n{Q}"),
    (f'<body><form name="aspnetForm"><div><a href="/">Start</a> <a href="/n">News</a></div><h2>Boats</h2><p>{P}</p><p>{Q} {R}</p></form></body>', f"Boats\n{P}\n{Q} {R}"),
    (f"<body><h1>Boats</h1><p>{P}</p><p>{Q}</p><p>Copyright 2020 by us</p></body>", f"Boats\n{P}\n{Q}"),
    (f"<body><h1>Boats</h1><p>{P}</p><p>{Q}</p><h3>Reader comments</h3><p>Bob: {R}</p><p>Eve: I was there.</p></body>", f"Boats\n{P}\n{Q}"),
    (f"<article><h1>Copyright</h1><p>Copyright is a right that nobody in the village had heard of when the first boats came in.</p><p>{P}</p></article>", f"Copyright\nCopyright is a right that nobody in the village had heard of when the first boats came in.\n{P}"),
])
def test_forms_imprints_and_talk(page, text):
    assert hb.main_text(page) == text


#: (page, its main blocks): sites of several kinds, written for this test.
PAGES = [
    (f'<html><body class="single-post"><header id="masthead"><a href="/">Fjord Times</a></header><nav id="site-navigation"><ul><li><a href="/a">World</a></li><li><a href="/b">Culture</a></li></ul></nav><div id="content" class="site-content"><main id="main"><article class="post type-post"><header class="entry-header"><h1 class="entry-title">Forty boats</h1><div class="entry-meta"><span>12 May</span></div></header><div class="entry-content"><p>{P}</p><p>{Q}</p><ul><li>Blue boats: 12</li><li>Red boats: 28</li></ul><p>{R}</p></div></article><section id="comments" class="comments-area"><h2>2 replies</h2><ol><li><p>Great read, thank you for this.</p></li></ol></section></main><aside id="secondary" class="widget-area"><h2>Recent</h2><ul><li><a href="/x">Old post</a></li></ul></aside></div><footer id="colophon"><p>Proudly made by hand</p></footer></body></html>',
     ["Forty boats", "12 May", P, Q, "Blue boats: 12", "Red boats: 28", R]),
    (f'<body><table><tr><td><a href="1.htm">Home</a> | <a href="2.htm">Links</a></td></tr></table><h1>My boat page</h1><p>{P}<p>{Q}<p>{R}<hr><p><a href="1.htm">Back</a></p></body>', ["My boat page", P, Q, R]),
    (f'<body><div class="cookie-consent"><p>We value your privacy and store cookies on your device to measure visits.</p><a href="/ok">Fine</a></div><div class="container"><div class="row"><div class="col-8"><h1>Boats in numbers</h1><p class="lead">{Q}</p><p>{P}</p><blockquote>{R}</blockquote></div><div class="col-4 sidebar"><h4>Popular</h4><p><a href="/p1">Ten knots to know</a></p></div></div></div><div class="footer"><p>All rights reserved</p></div></body>',
     ["Boats in numbers", Q, P, R]),
    (f'<body><div role="banner"><a href="/">Quay Daily</a></div><div role="main"><h1>The count</h1><p>{P} {Q}</p><p>{R}</p><p>No one slept.</p><p>{Q}</p></div><div role="complementary"><p>Our weekly letter comes on Fridays, straight into your mail box.</p></div><div role="contentinfo"><p>Contact, imprint, jobs</p></div></body>',
     ["The count", f"{P} {Q}", R, "No one slept.", Q]),
    (f'<main><h1>Recipe for fish soup</h1><p>{P}</p><h2>You need</h2><ul><li>Two cod</li><li>One onion</li><li>Salt</li></ul><h2>Do this</h2><ol><li>{Q}</li><li>{R}</li></ol></main><footer><p>A site for cooks</p></footer>',
     ["Recipe for fish soup", P, "You need", "Two cod", "One onion", "Salt", "Do this", Q, R]),
    (f'<body><nav><a href="/">Docs</a><a href="/api">API</a></nav><article><h1>Install</h1><p>{P}</p><pre>pip install boats</pre><p>{Q}</p></article><nav><a href="/next">Next page</a></nav></body>', ["Install", P, "pip install boats", Q]),
]


def test_blocks_of_other_sites():
    """At most one block in fifty is judged wrongly."""
    wrong, total = [], 0
    for page, main in PAGES:
        got = hb.main_text(page).split("\n")
        blocks = [b.text for b in hb.blocks_of(page)[0]]
        total += len(blocks)
        wrong += [b for b in blocks if (b in got) != (b in main)]
    assert len(wrong) <= total / 50, wrong

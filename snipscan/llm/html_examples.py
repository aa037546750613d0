"""The small labelled table for the block classifier: (page, its blocks of main text).

Pages are put together by a fixed rule from hand-written pieces: a way of laying out a page, and for each the parts that such
pages have around, between and after their paragraphs. Names mislead on purpose on some of them: wrappers of whole pages
are called after a part that they hold, and paragraphs of articles bear names that elsewhere mean boilerplate.
"""

from __future__ import annotations

from random import Random

_SENTENCES = """The river rose again in the night and by morning the lower fields lay under a hand of brown water.
Two farmers said that the old dam, built before the war, had held, but that its gates would have to be looked at.
Nobody could say when the road over the pass would open, for the snow had taken the bridge and half of the wall with it.
She had counted the birds from the same window for thirty years and never seen so few of them come back in April.
The council will meet on Monday to hear what the engineers have found under the market square.
Most of the bread in the valley is still baked with rye, because wheat doesn't ripen above the second lock.
In the archive lie the letters of a clerk who wrote down the price of salt each week from 1811 to 1838.
When the mill closed, the families who had worked in it for three generations moved to the port and learnt to build boats.
The telescope is pointed at one patch of sky for a month, and then the pictures are added up to show what no eye can see.
A reader who sets out from the station at eight can be at the upper lake by noon, if the weather holds.
Whoever wants to repair the roof has to ask the office first, and the office takes its time.
The second movement is slow, and the orchestra played it so softly that the rain on the glass could be heard.
Prices fell by a tenth in the spring and rose again by half of that before the harvest was in.
What the report leaves out is the cost of the pumps, which the town will pay for until the children of today are old.
He drew the map from memory, and later surveys found that he had been wrong by less than a mile.
The soup is cooked for three hours on a low fire and gets its colour from the skins of the onions.""".split("\n")
_SHORT = ["Nobody was hurt.", "That is all.", "The gates held.", "It rained.", "She laughed.", "So it stayed.", "Why not?", "He never went back.", "Work starts in May.", "Yes."]
_TITLES = ["High water", "Dam holds", "Letters from the valley", "Harvest", "Bread and rye", "The last mill", "A month of one sky", "Prices in spring", "What the clerk wrote", "How to reach the upper lake"]
_ITEMS = ["Gates shut at six", "Road open again", "Two onions and a bay leaf", "Rye flour, half a pound", "Boats leave on the hour", "Bring a lamp", "Salt, 1811: four pence", "Third pump to be tested"]
_NAV = ["Home", "News", "Sport and weather", "Shop", "Help", "About us", "Archive", "Contact", "Log in", "Letters page"]
_ADS = ["Buy two boats, pay for one, only this week.", "Flour at half price in our shop by the bridge, today only.", "Sleep better on a mattress of horse hair. Order it now and send it back within a hundred nights if it isn't the best bed that you have ever lain on.", "Lamps!", "Our readers choose the oil of Saint Martin for hinges, bicycles and clocks. Ask for it in any good shop in town, or write to us."]
_NOTICES = ["We use cookies so that the site works. By reading on you agree to all of them.", "This site will be down on Sunday morning while we move it to a new machine.", "You have read three of five free pages this month.", "Accept all"]
_FOOT = ["&copy; The Valley Post, all rights reserved by the owners.", "Printed in the valley. Terms of use apply to every reader of this page.", "Contact", "Powered by our own press", "Imprint and terms", "Made by hand on an old machine", "A paper for all who live between the two locks, since 1871"]
_COMMENTS = ["I was there and it was not half as bad as you write, the fields are wet each year and nobody ever made a story of it.", "Same here.", "First to write here, and glad of it, thank you all.", "My grandfather worked on that dam and told us every winter how the concrete was carried up by mules, which your paper has never mentioned with one word.", "Please correct the date in the second line."]
_RELATED = ["Mill to close after ninety years of work", "Bus fares up", "Old mills of the valley, in pictures", "Where to swim this summer", "Ten soups for cold days"]
_FORM = ["Your mail", "Get our letter each week, free and without any adverts.", "Write what you think of this page and we will print the best of it."]
_STRONG = {"ad": ["ad", "ads-box", "advert", "sponsored", "promo"], "notice": ["cookie-notice", "consent", "gdpr-bar", "popup"], "comment": ["comments", "comment-list", "replies", "disqus"], "related": ["related", "recommended-links", "share", "most-read related"], "menu": ["nav", "navbar", "main-menu", "breadcrumbs"], "side": ["sidebar", "side sidebar", "newsletter"]}
_WEAK = ["discussion", "legal", "entry-header", "notice", "tags", "banner", "post-header", "note copyright", "privacy", "skip", "search-help"]

_PARTLY = ["ad-hoc", "comment-culture", "cookie-jar", "menu-plan", "social-history", "nav-lights", "old-footer", "login-story", "related-studies", "promo-tour", "mill-teaser", "widget-maker", "toolbar-history", "reply-letter", "share-holders", "story__social"]
_VAGUE = ["promo", "related", "share", "social", "menu", "widget", "newsletter", "teaser", "reviews"]
_LAW = ["Copyright law was changed in the year in which the mill closed, and the clerk's letters became free for all to print.", "Copyright in the old maps lies with the town, which has never asked anybody for money.", "The privacy policy of the council fills four pages and says less than a line of the clerk's letters."]
_IMPRINT = ["Copyright 1998 the valley press", "© 2011 by the owners", "Copyright (c) 2004. All rights reserved.", "All rights reserved 1999-2015", "(c) Mill and Sons"]
_TALK = ["Comments", "3 comments", "Reader comments", "Leave a reply", "Responses (2)", "Your comments:"]
_NAMES = ["Anna", "Ben Miller", "river_man", "M. from the port"]


class _Maker:
    def __init__(self, seed: int):
        self.rng = Random(seed)
        self.main: set[str] = set()
        self.used = 0

    def _once(self, text: str) -> str:
        """``text`` made its own by a number, so that no other block of the page equals it."""
        self.used += 1
        return f"{text} {self.used}"

    def good(self, tag: str, text: str, attributes: str = "", close: bool = True) -> str:
        text = self._once(text)
        self.main.add(text)
        return f"<{tag}{attributes}>{text}" + (f"</{tag}>" if close else "")

    def bad(self, tag: str, text: str, attributes: str = "") -> str:
        return f"<{tag}{attributes}>{self._once(text)}</{tag}>"

    def links(self, texts: list[str], tag: str = "") -> str:
        one = [f'<a href="/{i}">{self._once(t)}</a>' for i, t in enumerate(texts)]
        return "".join(f"<{tag}>{x}</{tag}>" for x in one) if tag else " ".join(one)

    def link(self, text: str, tag: str = "p") -> str:
        text = self._once(text)
        self.main.add(text)
        link = f'<a href="/x">{text}</a>'
        return f"<{tag}>{link}</{tag}>" if tag else link

    def told_in(self) -> str:
        """A part of an article whose name elsewhere means boilerplate; it is as long as parts of articles are."""
        r = self.rng
        head = self.good(r.choice(["h2", "h3"]), r.choice(_TITLES)) if r.random() < 0.5 else ""
        return f'<section class="{r.choice(_VAGUE)}">{head}{"".join(self.good("p", " ".join(r.sample(_SENTENCES, r.choice([2, 3])))) for _ in range(r.randint(1, 4)))}</section>'

    def prose(self) -> str:
        """A paragraph of four words to three sentences."""
        if self.rng.random() < 0.3:
            return " ".join(self.rng.choice(_SENTENCES).split()[: self.rng.randint(4, 15)]) + "."
        return " ".join(self.rng.sample(_SENTENCES, self.rng.choice([1, 1, 2, 3])))

    def linked(self) -> str:
        a, b = self.rng.sample(_SENTENCES, 2)
        text = self._once(f"{a} A fuller account stands in the report. {b}")
        self.main.add(text)
        return "<p>" + text.replace("the report", '<a href="/r">the report</a>', 1) + "</p>"

    def body(self, tag: str = "p", names: bool = False) -> list[str]:
        """The blocks of an article: paragraphs, short ones among them, a list, a table, a quotation."""
        r, out = self.rng, []
        for _ in range(r.randint(0 if names else 1, 6)):
            weak = f' {r.choice(["class", "id"])}="{r.choice([*_WEAK, *_PARTLY])}"' if names and r.random() < 0.5 else ""
            out.append(self.good(tag, self.prose(), weak))
            if r.random() < 0.5:
                out.append(self.good(tag, r.choice(_SHORT)))
        if names:  # in an article even a line that is one link, or the first word, is text
            out.insert(r.randint(0, len(out)), r.choice([lambda: self.link(r.choice(_RELATED)), lambda: self.good("p", r.choice(_SHORT)), lambda: f"<ul><li>{self.link(r.choice(_RELATED), '')}</li></ul>"])())
            for at in (0, len(out)):
                if r.random() < 0.6:
                    out[at:at] = [self.good(tag, r.choice([*_SHORT, *_TITLES])) for _ in range(r.randint(1, 3))]
        kinds = [
            lambda: f"<ul>{''.join(self.good('li', x) for x in r.sample(_ITEMS, 3))}</ul>", lambda: self.linked(), lambda: self.good("blockquote", r.choice(_SENTENCES)),
            lambda: "<table>" + "".join(f"<tr>{self.good('td', x)}{self.good('td', 'some 40 tons')}</tr>" for x in r.sample(_ITEMS, 2)) + "</table>", lambda: self.good("h2", r.choice(_TITLES)),
        ]
        if names:
            kinds += [
                lambda: f'<section class="{r.choice(_PARTLY)}">{self.good("h3", r.choice(_TITLES)) if r.random() < 0.5 else ""}{"".join(self.good("p", r.choice([self.prose(), r.choice(_SHORT)])) for _ in range(r.randint(1, 4)))}</section>',
                self.told_in,
                lambda: self.good("p", r.choice([*_LAW, *_IMPRINT])), lambda: self.good("p", r.choice(_IMPRINT)),
            ]
        for kind in r.sample(kinds, r.randint(0, 3)):
            out.insert(r.randint(0 if names else min(1, len(out)), len(out)), kind())
        return out


def _semantic(m: _Maker) -> str:
    """Tags say what parts are; adverts and comments stand within the article too; names mislead."""
    r = m.rng
    around = r.choice(["{}", '<div class="page has-sidebar">{}</div>', '<div class="layout-sidebar">{}</div>', '<div id="content-banner" style="overflow:hidden">{}</div>', '<form id="f">{}</form>'])
    inside = m.body(names=True)
    if r.random() < 0.25:
        inside.append(m.told_in())
    if r.random() < 0.25:  # a very short article
        m.main.clear()
        inside = [m.link(r.choice(_RELATED)) if r.random() < 0.4 else m.good("p", r.choice(_SHORT)) for _ in range(r.randint(1, 3))]
    name = r.choice(_STRONG["ad"])
    spot = r.randint(0, len(inside))
    inside.insert(spot, r.choice([lambda: m.bad("div", r.choice(_ADS), f' class="{name}"'), lambda: f'<p class="{name}">{m._once(r.choice(_ADS))}', lambda: "", lambda: f"<aside>{m.bad('p', r.choice(_SENTENCES))}</aside>", lambda: f"<form>{m.bad('label', _FORM[0])}{m.bad('p', r.choice(_FORM[1:]))}</form>"])())
    head = r.choice([lambda: m.good("h1", r.choice(_TITLES)), lambda: m.good("h1", r.choice(_TITLES), ' class="entry-header"'), lambda: f'<header class="post-header">{m.good("h1", r.choice(_TITLES))}{m.good("p", r.choice(_SHORT))}</header>', lambda: ""])()
    tail = r.choice([lambda: "", lambda: "", lambda: "", lambda: f'<section class="{r.choice(_STRONG["comment"])}">{"".join(m.bad("p", x) for x in r.sample(_COMMENTS, 3))}</section>', lambda: f'<div class="{r.choice(_STRONG["related"])}">{m.links(r.sample(_RELATED, 3), "p")}</div>', lambda: f"<footer>{m.bad('p', r.choice(_FOOT))}</footer>", lambda: f"<p hidden>{m._once(r.choice(_SENTENCES))}</p>"])()
    tag = r.choice(["article", "article", "main"])
    after = [f"<aside><h3>{m._once('Most read')}</h3><ul>{m.links(r.sample(_RELATED, 3), 'li')}</ul></aside>", f'<div class="{r.choice(_STRONG["side"])}">{m.bad("p", r.choice(_SENTENCES))}</div>', f'<article class="comment">{m.bad("p", r.choice(_COMMENTS))}</article>', f'<div class="notice">{m.bad("p", r.choice(_NOTICES))}</div>', f'<section id="{r.choice(_STRONG["comment"])}">{"".join(m.bad("p", x) for x in _COMMENTS)}</section>', m.bad("p", r.choice(_FOOT)), m.links(r.sample(_RELATED, 2), "p")]
    site = r.choice([f"<header>{m.links([r.choice(_NAV)])}</header>", f"<header>{m.bad('p', r.choice(_NOTICES))}</header>", ""])
    top = r.choice(["", m.bad("div", r.choice(_ADS), ' class="ad"'), m.bad("div", r.choice(_NOTICES), f' class="{r.choice(_STRONG["notice"])}"'), m.bad("p", r.choice(_NOTICES))])
    nav = r.choice([f"<nav><ul>{m.links(r.sample(_NAV, 4), 'li')}</ul></nav>"] * 2 + [""])
    if r.random() < 0.35:  # an article and little else
        return around.format(f"{r.choice([top, nav, '', ''])}<{tag}>{head}{''.join(inside)}{tail}</{tag}>")
    page = f"{site}{nav}{top}<{tag}>{head}{''.join(inside)}{tail}</{tag}>{''.join(r.sample(after, r.randint(0, 3)))}{r.choice([f"<footer>{m.bad('p', r.choice(_FOOT))}</footer>", ""])}"
    return f"<html><head><title>x</title></head><body>{around.format(page)}</body></html>"


def _named(m: _Maker) -> str:
    """No tags but divs: class names and ids say what parts are, and some of them are of no help."""
    r = m.rng
    comments = f'<div class="{r.choice(_STRONG["comment"])}">{m.bad("h3", "Comments")}{"".join(m.bad("p", x) for x in _COMMENTS[: r.randint(1, 5)])}</div>'
    text = f'<div class="{r.choice(["content", "c1", "wrap with-comments", "text"])}">{m.good("h1", r.choice(_TITLES))}{"".join(m.body(r.choice(["p", "p", "div"])))}</div>'
    pieces = [m.bad("div", r.choice(_ADS), f' class="{r.choice(_STRONG["ad"])}"'), m.bad("div", r.choice(_NOTICES), f' id="{r.choice(_STRONG["notice"])}"')]
    ending = [comments, f'<div class="{r.choice(_STRONG["side"])}">{m.bad("p", r.choice(_SENTENCES))}{m.links(r.sample(_RELATED, 2), "p")}</div>', m.bad("div", r.choice(_FOOT), ' class="footer"'), m.bad("div", r.choice(_SENTENCES), ' style="display: none"')]
    inner = f'<div class="{r.choice(_STRONG["menu"])}">{m.links(r.sample(_NAV, 4))}</div>{"".join(r.sample(pieces, r.randint(0, 2)))}{text}{"".join(r.sample(ending, r.randint(1, 4)))}'
    return "<body>" + r.choice(["{}", '<div id="sidebar-page">{}</div>', '<div class="nav-wrapper">{}</div>', '<div class="overflow-hidden">{}</div>', '<form method="post" action="/page">{}</form>']).format(inner) + "</body>"


def _talked(m: _Maker) -> str:
    """Comments and imprints that neither tag nor name sets apart, often in one form around the page; what names there are mislead."""
    r = m.rng
    body = m.body(r.choice(["p", "p", "div"]))
    if r.random() < 0.3:
        body.insert(r.randint(0, len(body)), m.good("p", r.choice(_LAW)))
    body.append(m.good("p", m.prose()))
    head = m.good("h1", r.choice(_TITLES))
    told = "".join(m.bad("p", f"{r.choice(_NAMES)}: {x}" if r.random() < 0.7 else x) for x in r.sample(_COMMENTS, r.randint(1, 4)))
    tag = r.choice(["h2", "h3", "p", "div"])
    talk = f"<{tag}>{r.choice(_TALK)}</{tag}>{told}" if r.random() < 0.6 else ""
    foot = m.bad(r.choice(["p", "div"]), r.choice(_IMPRINT)) if not talk or r.random() < 0.5 else ""
    tag = r.choice(["div", "div", "article", "main", "section"])
    inside = f'<{tag}{r.choice(["", f" class={chr(34)}{r.choice(_PARTLY)}{chr(34)}", " class=text"])}>{head}{"".join(body)}</{tag}>'
    if tag in ("article", "main") and r.random() < 0.4:  # comments within the article
        inside = f"<{tag}>{head}{''.join(body)}{talk}</{tag}>"
        talk = ""
    small = r.choice(["", f'<div class="user-{r.choice(["comments", "menu"])}">{m.links(r.sample(_NAV, 3))}</div>', m.links(r.sample(_NAV, 3), "p")])
    return "<body>" + r.choice(["{}", '<form id="form1">{}</form>', '<form method="post"><div>{}</div></form>']).format(f"{small}{inside}{talk}{foot}") + "</body>"


def _bare(m: _Maker) -> str:
    """Neither tags nor names: only words, links and what stands before and after tell."""
    r = m.rng
    top = r.choice(["", m.bad("div", r.choice(["Call us on weekdays", "The Valley Post", "Tuesday, 4 May"]))])
    menu = r.choice([f"<div>{m.links(r.sample(_NAV, 4))}</div>", f"<ul>{m.links(r.sample(_NAV, 4), 'li')}</ul>", m.links(r.sample(_NAV, 3), "p")])
    head = m.good(r.choice(["h1", "h2"]), r.choice(_TITLES)) if r.random() < 0.8 else ""
    blocks = [m.good("p", m.prose())]
    for _ in range(r.randint(2, 6)):
        blocks.append(m.good("p", r.choice([m.prose(), m.prose(), r.choice(_SHORT)])))
    blocks.append(m.good("p", m.prose()))
    end = r.choice([m.links(r.sample(_RELATED, 3), "p"), f"<ul>{m.links(r.sample(_RELATED, 2), 'li')}</ul>", f"<div>{m.links(r.sample(_NAV, 2))}</div>"])
    foot = "".join(m.bad("p", x) for x in r.sample(_FOOT, r.randint(1, 2)))
    if r.random() < 0.3:
        end, foot = "", r.choice(["", foot])
    around = r.choice(["{}", "{}", "{}", '<form id="f1" action="/self">{}</form>'])
    return "<body>" + around.format(f"{top}{r.choice([menu, menu, ''])}{head}{''.join(blocks)}{end}{foot}") + "</body>"


def _plain(m: _Maker) -> str:
    """Paragraphs and nothing else."""
    text = m.rng.choice(["", m.good("h1", m.rng.choice(_TITLES))]) + "".join(m.body())
    return m.rng.choice(["{}", "{}", '<form method="post"><div>{}</div></form>']).format(text)


def _table() -> list[tuple[str, set[str]]]:
    out = []
    for k, layout in enumerate([_semantic] * 260 + [_named] * 80 + [_bare] * 120 + [_plain] * 60 + [_talked] * 120):
        m = _Maker(k)
        out.append((layout(m), m.main))
    return out


PAGES: list[tuple[str, set[str]]] = _table()

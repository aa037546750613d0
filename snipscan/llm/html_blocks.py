"""HTML extraction by flat text blocks.

The tags cut a page into blocks of text. A block is described by its words and link density, those of the blocks before and
after it, and where it stands: in an article, a list, a heading, after a heading of readers' comments, and in parts that their tags
or names say are apart, with the share of the page's words that such a part holds, its links, and whether it holds an article.
A name that is only in part one of those ("market-share") says less than a whole one ("share-buttons"). A decision tree, grown on a
small labelled table of pages, says which blocks are main text; nothing is taken out before it but what isn't text
(scripts, styles, the head, controls).

A null or empty page has no text. Broken mark-up never fails: a block tag ends an open paragraph, an open comment or script
runs to the page's end, an end tag without a start is passed over. A very long page is read whole. Repeated rows get equal
texts, blocks that are repeated stay repeated. An empty table gives an empty result. A column ``_text`` of the input is kept: the result then has one more underscore.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipscan.llm.common import free_name, small_batches
from snipscan.llm.html_examples import PAGES

#: Tags whose content isn't text, those of them that run to the page's end if they aren't closed, tags that cut blocks. Fixed values.
DROPPED = "script style noscript template svg iframe select button textarea canvas object head title annotation annotation-xml datalist audio video map"
RAW = "script style textarea iframe"
BLOCK = "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul"
#: What an opening tag ends without an end tag, and the tags beyond which it doesn't. Fixed values.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table"), "tbody": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody", "table"), "option": ("option", "select")}
LINES = "p h1 h2 h3 h4 h5 h6"
#: Parts apart from the text by their tag. Names in class, id and role: those that say so by themselves, those that articles have uses
#: for too, those that also stand on parts of articles, what may stand beside them in a longer name; names of parts whose own
#: articles aren't the page's. Fixed values.
APART_TAGS = "nav footer aside form menu dialog fieldset"
STRONG = "ad ads advert advertisement advertising advertorial adslot adsbygoogle breadcrumb breadcrumbs comment comments commentlist commentbox complementary consent contentinfo cookie cookies disqus footer gdpr masthead nav navbar navigation pager pagination paywall replies reply respond sidebar sidenav signup sitemap skiplink sponsored toolbar topbar"
VAGUE = "login menu modal newsletter popup promo promoted recommended related reviews share sharing social sponsor subscribe teaser widget"
WEAK = "alert banner copyright disclaimer discussion header legal notice privacy search skip tags toc"
BESIDE = "area bar block bottom box buttons column container desktop first form global group inner last left links list main mobile module most outer page panel post posts primary read right row secondary section site slot top unit widget wrap wrapper"
OTHERS = "comment comments reply replies teaser related promo sponsored"
#: What a name says, from the clearest on: a part apart by all of the name, a name that is both, a name that is only partly one of these, a weak one.
HINTS = ("strong", "vague", "partly", "weak")

_DROPPED, _RAW, _BLOCK, _LINES, _APART, _STRONG, _VAGUE, _WEAK, _BESIDE, _OTHERS = (frozenset(x.split()) for x in (DROPPED, RAW, BLOCK, LINES, APART_TAGS, STRONG, VAGUE, WEAK, BESIDE, OTHERS))
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
_LISTS = frozenset(("ul", "ol", "menu", "dl"))
_MAIN = frozenset(("article", "main"))
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_STATES = frozenset("has with no without".split())  # first parts of a class that says what a wrapper holds
#: Shares of its blocks that the thinned copies of a labelled page keep.
THINNED = (0.7, 0.4, 0.2)
FEATURES = ["words", "link_density", "words_before", "links_before", "words_after", "links_after", "article", "apart", "apart_share", "hidden", *(x for h in HINTS for x in (h, f"{h}_share")), "named_words", "named_links", "heading", "listed", "tabled", "legal", "talk"]
#: What lines of imprints say, of so many words at most, and headings of readers' comments.
IMPRINT = 40
_LEGAL = re.compile(r"^\W{0,3}(?:copyright|©|\(c\))|\ball rights reserved\b|\bpowered by\b|\bterms (?:of (?:use|service)|and conditions)\b|\bprivacy policy\b", re.I)
_TALK = re.compile(r"^(?:\d+ )?(?:(?:reader|user|your|latest|recent|all|visitor)s?'? )?(?:comments?|replies|responses|reactions)(?: ?\(\d+\))?:?$|^(?:leave|post|write|add) (?:a|your) (?:comment|reply|response)", re.I)


@dataclass
class Part:
    """An open element that its tag or name says is apart: its kind, words, and whether it holds an article of the page."""

    kind: str
    sure: bool = False
    words: int = 0
    linked: int = 0
    holds: bool = False


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    hidden: bool
    heading: bool
    listed: bool
    tabled: bool
    parts: tuple[int, ...]


def _hint(name: str, tag: str) -> tuple[str, bool]:
    """What a class, id or role says of the element (one of HINTS or nothing), and whether an article within changes nothing."""
    w = [x for x in re.split(r"[^a-z]+", name) if x]
    if not w or w[0] in _STATES:
        return "", False
    ends, parts = {w[0], w[-1]}, set(w)
    if tag == "article":
        return ("strong", True) if ends & _OTHERS else ("", False)
    if parts <= _STRONG | _VAGUE | _WEAK | _BESIDE:
        if parts & _STRONG:
            return "strong", len(w) == 1 and w[0] in _OTHERS
        if parts & _VAGUE:
            return "vague", False
    if ends & (_STRONG | _VAGUE):
        return "partly", False
    return ("weak", False) if ends & _WEAK else ("", False)


@lru_cache(4096)
def _marks(tag: str, attributes: str) -> tuple[bool, str, bool]:
    """(hidden, what its names hint at, whether an article within changes nothing)."""
    hidden, hints, sure = False, set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        hidden |= name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and bool(_UNSEEN.search(value)))
        if name in ("class", "id", "role") and tag not in ("html", "body", "main"):
            for token in _HUMP.sub("-", value).lower().split():
                hint, certain = _hint(token, tag)
                hints.add(hint)
                sure |= certain
    return hidden, next((h for h in HINTS if h in hints), ""), sure


@dataclass
class _Open:
    """An open element: its tag, whether it hides what it holds, and its part (-1: none)."""

    tag: str
    hidden: bool
    part: int


def blocks_of(page: str) -> tuple[list[Block], list[Part]]:
    """The page's blocks of text in order, and the parts apart that they refer to."""
    out: list[Block] = []
    parts: list[Part] = []
    stack: list[_Open] = []
    count: dict[str, int] = {}  # open elements by tag
    hidden = 0
    anchor = -1  # elements that were open where the open link began; -1: none
    unseen = ""  # an inline tag that hides its content
    text: list[str] = []
    linked: list[str] = []
    open_ended: set[str] = set()  # tags without an end tag from here on

    def within(tags) -> bool:
        return any(count.get(t) for t in tags)

    def end() -> None:
        words = " ".join(entities.unescape("".join(text)).split())
        if words:
            n, open_parts = len(words.split()), tuple(o.part for o in stack if o.part >= 0)
            in_links = len(entities.unescape(" ".join(linked)).split())
            for k in open_parts:
                parts[k].words += n
                parts[k].linked += in_links
            line = stack[-1].tag if stack else ""
            out.append(Block(words, n, in_links, within(_MAIN), hidden > 0, line[:1] == "h" and line[1:].isdigit(), within(_LISTS), bool(count.get("table")), open_parts))
        text.clear()
        linked.clear()

    def pop() -> None:
        nonlocal hidden, anchor
        o = stack.pop()
        count[o.tag] -= 1
        hidden -= o.hidden
        if anchor > len(stack):
            anchor = -1

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        piece = page[at : m.start() if m else size]
        if piece and not unseen:
            text.append(piece)
            if anchor >= 0:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _DROPPED and not closing:
            if not m[3].rstrip().endswith("/"):
                stop = None if tag in open_ended else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if tag == "head" and not stop:
                    stop = re.compile(r"(?=<body\b)", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif tag in _RAW:
                    at = size
                else:
                    open_ended.add(tag)
            text.append(" ")
        elif tag == "a":
            anchor = -1 if closing else len(stack)
        elif tag == "br":
            text.append(" ")
        elif tag == "hr":
            end()
        elif tag not in _BLOCK:
            if closing and tag == unseen:
                unseen = ""
            elif not closing and m[3] and not unseen and not m[3].rstrip().endswith("/") and tag not in ("img", "input", "wbr") and _marks(tag, m[3])[0]:
                unseen = tag
        else:
            end()
            unseen = ""
            if closing:
                if count.get(tag):
                    while stack[-1].tag != tag:
                        pop()
                    pop()
                continue
            while stack and stack[-1].tag in _LINES:
                pop()
            ended, beyond = _ENDS.get(tag, (frozenset(), frozenset()))
            if within(ended):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in beyond:
                        break
                    if stack[k].tag in ended:
                        while len(stack) > k:
                            pop()
                        break
            hides, hint, sure = _marks(tag, m[3]) if m[3] else (False, "", False)
            apart = tag in _APART or (tag == "header" and not within(_MAIN))
            if tag in _MAIN and not hides and not (hint and sure):
                for o in stack:
                    if o.part >= 0:
                        parts[o.part].holds = True
            part = -1
            if apart or hint:
                parts.append(Part(hint if hint == "strong" or not apart else "apart", sure))
                part = len(parts) - 1
            stack.append(_Open(tag, hides, part))
            count[tag] = count.get(tag, 0) + 1
            hidden += hides
    end()
    return out, parts


def describe(blocks: list[Block], parts: list[Part]) -> np.ndarray:
    """A row of FEATURES for each block.

    "article" is 2 in an article, 0 outside of those of the page, 1 on a page without one. "apart" and what names say are 2 in such
    a part, 1 if all such parts around the block hold an article, else 0; the shares are of the page's words in the smallest such
    part around it, 1 without any; in an article a name that is partly or weakly one of these says nothing. "named_words" and "named_links" are the words and link density of the innermost part with a
    name. "legal" is 1 for a line of an imprint, "talk" from a heading of readers' comments to the next heading.
    """
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in blocks], float)
    density = np.array([min(1.0, b.linked / max(1, b.words)) for b in blocks])
    shift = lambda x, k: np.concatenate(([0.0], x[:-1])) if k < 0 else np.concatenate((x[1:], [0.0]))
    has, total = any(b.article for b in blocks), words.sum()

    def level(b: Block, kind: str) -> tuple[float, float]:
        if not b.parts:
            return 0.0, 1.0
        around = [parts[k] for k in b.parts if parts[k].kind == kind]
        return max((1.0 if p.holds and not p.sure else 2.0 for p in around), default=0.0), min((min(1.0, p.words / total) for p in around), default=1.0)

    def named(b: Block) -> tuple[float, float]:
        inner = next((parts[k] for k in reversed(b.parts) if parts[k].kind != "apart"), None)
        return (float(inner.words), min(1.0, inner.linked / max(1, inner.words))) if inner else (0.0, 0.0)

    rows, talk = [], False
    for b in blocks:
        said = b.words <= 6 and bool(_TALK.search(b.text))
        talk = said or (talk and not b.heading)
        hints = [x for h in HINTS for x in ((0.0, 1.0) if b.article and h in ("partly", "weak") else level(b, h))]
        rows.append([2 * b.article if has else 1, *level(b, "apart"), b.hidden, *hints, *named(b), b.heading, b.listed, b.tabled, b.words <= IMPRINT and bool(_LEGAL.search(b.text)), talk])
    return np.column_stack([words, density, shift(words, -1), shift(density, -1), shift(words, 1), shift(density, 1), np.array(rows, float)])


@dataclass
class Tree:
    """Nodes in arrays: column and cut (column -1 at a leaf), children, and the share of main text in the leaf."""

    column: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    child: list[tuple[int, int]] = field(default_factory=list)
    share: list[float] = field(default_factory=list)

    def main(self, x: np.ndarray) -> np.ndarray:
        """Whether each row is main text. Blocks of a page are few, so each walks down by itself."""
        column, cut, child, share = self.column, self.cut, self.child, self.share
        out = []
        for row in x.tolist():
            node = 0
            while (c := column[node]) >= 0:
                node = child[node][row[c] > cut[node]]
            out.append(share[node] >= 0.5)
        return np.array(out, bool)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 18, least: int = 2) -> Tree:
    """A decision tree by the Gini gain; ties go to the earlier column and the lower cut."""
    tree = Tree()

    def node(rows: np.ndarray, level: int) -> int:
        me = len(tree.column)
        tree.column.append(-1)
        tree.cut.append(0.0)
        tree.child.append((0, 0))
        tree.share.append(float(y[rows].mean()))
        if level == depth or tree.share[me] in (0.0, 1.0) or len(rows) < 2 * least:
            return me
        best = (1e-9, -1, 0.0)
        impure = lambda n, k: k - k * k / n
        n, k = len(rows), y[rows].sum()
        for c in range(x.shape[1]):
            order = rows[np.argsort(x[rows, c], kind="stable")]
            v, left = x[order, c], np.cumsum(y[order])[:-1]
            size = np.arange(1, n)
            gain = impure(n, k) - impure(size, left) - impure(n - size, k - left)
            gain[(v[1:] == v[:-1]) | (size < least) | (n - size < least)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best[0] + 1e-9:
                best = (gain[at], c, float(v[at] + v[at + 1]) / 2)
        if best[1] >= 0:
            right = x[rows, best[1]] > best[2]
            tree.column[me], tree.cut[me] = best[1], best[2]
            tree.child[me] = (node(rows[~right], level + 1), node(rows[right], level + 1))
        return me

    node(np.arange(len(y)), 0)
    return tree


def table_rows() -> tuple[np.ndarray, np.ndarray]:
    """(features, 1 for main text) of all blocks of the labelled table PAGES, and of copies of its pages that lack some blocks, so that any block may be first, last or next to any other."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for page, main in PAGES:
        blocks, parts = blocks_of(page)
        whole = any(_TALK.search(b.text) or _LEGAL.search(b.text) for b in blocks)  # what is thinned out there would leave talk that looks like text
        for share in (1.0, *(() if whole else THINNED)):
            some = [b for b in blocks if rng.random() < share]
            rows.append(describe(some, parts))
            labels += [float(b.text in main) for b in some]
    return np.concatenate(rows), np.array(labels)


@lru_cache(1)
def trained() -> Tree:
    """The tree for the labelled table."""
    return grow(*table_rows())


def main_text(page: str | None, tree: Tree | None = None) -> str:
    if not page:
        return ""
    blocks, parts = blocks_of(page)
    if not blocks:
        return ""
    keep = (tree or trained()).main(describe(blocks, parts))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the main text in the column ``_text``, the last."""
    small_batches(pages.sparkSession)
    tree = trained()

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x, tree) for x in column.to_pylist()], pa.string())

    return pages.withColumn(free_name(pages, "_text"), extract.asNondeterministic()(F.col(html)))

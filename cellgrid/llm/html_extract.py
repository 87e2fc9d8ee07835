"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at its block elements.  The first pass looks at each
block alone: the element it stands in, its link density, its length and the
density of stop words.  Blocks in menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are boilerplate; long prose is content; what
is too short or too strange to tell is ambiguous.  The second pass gives every
ambiguous block the label of its nearest decided neighbours: their common label,
or that of the nearer one, and content only if that one is nearer.

In a page that marks its article, blocks outside are boilerplate and blocks
inside are content unless they are mostly links.  In a page without any prose of
a known language, long blocks are content, and if there are none the short ones.

Nulls: a null page is empty, and an empty page has the empty text.  Repeated rows
get equal results; other columns are not read.  An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import map_texts, prepare

SHORT_CHARS = 70
PROSE_STOP_WORDS = 0.15
LINK_DENSITY = 0.4

# Frequent words of four languages.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or that the their they this to "
    "was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas pour qui que sa se ses son "
    "sur un une vous "
    "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht "
    "noch oder sich sie sind so und von vor war wie wird zu zum zur "
    "al como con del el ella ellos era esta este ha la las lo los más me muy no nos o para pero por se si sin sobre su sus "
    "también una uno y ya".split()
)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no text of the page.
RAW_TAGS = frozenset("script style noscript template svg math iframe object textarea title select canvas audio video".split())
BOILER_TAGS = frozenset("aside button dialog footer form menu nav".split())
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
# Parts of class names and ids.  The first kind is always boilerplate, the second unless the name is also one of content.
COMMENT_NAMES = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
BOILER_NAMES = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs byline consent cookie cookies copyright "
    "disclaimer footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification "
    "pager pagination popup promo promoted promotion recommended related search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
CONTENT_NAMES = frozenset("article body content entry main post story text".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]++|\"[^\"]*\"|'[^']*'){0,64}+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
NAME = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TAGS}
HEADING = re.compile("h[1-6]$")


def _kind(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element starts boilerplate, and whether it starts the article."""
    article = tag in ("article", "main")
    boiler = tag in BOILER_TAGS or (tag == "header" and not inside)
    if attributes and tag not in ("html", "body"):
        for name, *values in NAME.findall(attributes):
            name, value = name.lower(), "".join(values)
            low = value.lower()
            if name == "hidden" or (name == "aria-hidden" and low == "true"):
                boiler = True
            elif name == "style":
                boiler |= "display:none" in low.replace(" ", "")
            elif name == "role":
                article |= low in ("main", "article")
                boiler |= low in BOILER_ROLES
            elif name == "itemprop":
                article |= low == "articlebody"
                boiler |= low == "comment"
            else:
                parts = {p.lower() for p in PART.findall(value)}
                if parts & COMMENT_NAMES:
                    boiler = True
                elif parts & BOILER_NAMES and not parts & CONTENT_NAMES and not article:
                    boiler = True
    return boiler, article and not boiler


class Block:
    __slots__ = ("parts", "links", "boiler", "article", "heading")

    def __init__(self, boiler: bool, article: bool, heading: bool):
        self.parts: list[str] = []
        self.links = 0
        self.boiler, self.article, self.heading = boiler, article, heading

    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; broken markup ends with the element around it."""
    # open elements: tag, boilerplate, article, link
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    out: list[Block] = []
    current: Block | None = None
    at, end = 0, len(page)

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            if not text or text.isspace():
                return
            _, boiler, article, _ = stack[-1]
            current = Block(boiler, article, any(HEADING.match(s[0]) for s in stack[-4:]))
            out.append(current)
        current.parts.append(text)
        if stack[-1][3]:
            current.links += len(" ".join(text.split()))

    while at < end:
        found = TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            current = None
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    # what was left open inside ends here; an inline end never ends a block
                    if tag in BLOCK_TAGS or not any(s[0] in BLOCK_TAGS for s in stack[depth:]):
                        was = stack[-1]
                        del stack[depth:]
                        if stack[-1][1:3] != was[1:3]:
                            current = None
                    break
            continue
        if tag in RAW_TAGS:
            if not attributes.endswith("/"):
                stop = END[tag].search(page, at)
                at = stop.end() if stop else (end if tag in ("script", "style") else at)
            continue
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        if tag == "p" or tag in BLOCK_TAGS:
            # a paragraph ends where the next block begins
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCK_TAGS:
                    break
        _, boiler, article, link = stack[-1]
        starts_boiler, starts_article = _kind(tag, attributes, article)
        stack.append((tag, boiler or starts_boiler, article or starts_article, link or tag == "a"))
        if starts_boiler or starts_article:
            current = None
    return out


GOOD, BAD, OPEN = 1, 0, -1


def first_pass(block: Block, text: str, marked: bool) -> int:
    """Label of a block by itself; ``marked``: the page marks its article."""
    if block.boiler or (marked and not block.article):
        return BAD
    dense = block.links > LINK_DENSITY * len(text)
    if dense and not block.heading:
        return BAD
    words = text.lower().split()
    share = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if len(text) >= SHORT_CHARS and share >= PROSE_STOP_WORDS:
        return GOOD
    return OPEN


def second_pass(labels: list[int], default: int) -> list[int]:
    """Ambiguous blocks take the label of their nearest decided neighbours."""
    n = len(labels)
    before, after = [(default, n + 1)] * n, [(default, n + 1)] * n
    last = None
    for i in range(n):
        if labels[i] != OPEN:
            last = (labels[i], i)
        elif last:
            before[i] = (last[0], i - last[1])
    last = None
    for i in range(n - 1, -1, -1):
        if labels[i] != OPEN:
            last = (labels[i], i)
        elif last:
            after[i] = (last[0], last[1] - i)
    out = []
    for label, (a, far_a), (b, far_b) in zip(labels, before, after):
        if label != OPEN:
            out.append(label)
        elif a == b:
            out.append(a)
        elif far_a == far_b:
            out.append(BAD)
        else:
            out.append(a if far_a < far_b else b)
    return out


def extract(page: str | None) -> str:
    """The main text: content blocks joined by line breaks."""
    found = [(b, b.text()) for b in blocks(page or "")]
    found = [(b, t) for b, t in found if t]
    marked = any(b.article and not b.boiler for b, _ in found)
    labels = [first_pass(b, t, marked) for b, t in found]
    if marked:
        # only blocks inside the article that are no lists of links count as neighbours
        inner = [i for i, label in enumerate(labels) if label != BAD]
        for i, label in zip(inner, second_pass([labels[i] for i in inner], GOOD)):
            labels[i] = label
    else:
        if GOOD not in labels:
            # no known language: long blocks count as prose, and without any there is nothing but short text
            size = SHORT_CHARS if any(a == OPEN and len(t) >= SHORT_CHARS for a, (_, t) in zip(labels, found)) else 0
            labels = [GOOD if a == OPEN and len(t) >= size else a for a, (_, t) in zip(labels, found)]
        labels = second_pass(labels, BAD)
    return "\n".join(t for (_, t), label in zip(found, labels) if label == GOOD)


def main_texts(pages: DataFrame, id_col: str = "page_id", html: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the columns ``carry``, ``text`` and ``n_chars`` of every page."""
    prepare(pages.sparkSession)
    names = [id_col, *carry]
    inner = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.col(html).alias("html"))
    kinds = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(names))

    def run(part):
        texts = [extract(p) for p in part["html"]]
        yield {k: v for k, v in part.items() if k != "html"} | {"text": texts, "n_chars": [len(t) for t in texts]}

    got = map_texts(inner, run, f"{kinds}, text string, n_chars bigint", "html")
    return got.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "text", "n_chars")

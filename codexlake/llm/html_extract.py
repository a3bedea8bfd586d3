"""Main text of web pages by composite text density.

A page is read into a tree in one pass. Elements whose very name says
that they are no text of an article (menus, footers, asides, scripts, styles, controls), and elements that are hidden
(``hidden``, ``aria-hidden="true"``), are cut off; a
header is, unless it is an article's or the main element's own; a form is, unless it holds most of
the page. Every other node gets its density: characters per tag, adjusted by the share of link characters and link tags
as in the published composite text density. Class, id and role words that speak of notices, adverts,
sidebars, comments and the like divide the density of a node and of what is in it by ``PENALTY``; an
article or main element inside starts afresh. They drop nothing by themselves.

A node's density sum is that of its children's densities. The node of the greatest sum, and its path up
to the body, give the threshold: the least density on that path. From the body down, each subtree
that reaches the threshold, and whose greatest sum (or own density) agrees with the page's, gives its node of greatest sum, widened to
the article or main element, or else the container, around it if that one is at least ``AGREES`` times as dense or holds most of the text. The
text of all these nodes is the result, without penalised parts below the threshold or below ``AGREES`` times the density of the node
they are in, without containers less dense than one beside them that holds most of what both are in, and without those of links
in a node that is not. So short lines around a text (menus, imprints, notices) go on pages without telling names too.

Defined results: null or empty html, or a page without text outside of what is cut off, gives an
empty text; an unclosed or cut off page is read as far as it goes; elements nested deeper than
``MAX_DEPTH`` are read as if side by side; repeated rows are extracted alike; an empty table gives an
empty result; other columns are passed on as they are, but one named like the output, which is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no part of a text.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside button input select option textarea iframe object svg canvas video audio dialog menu".split()
)
#: Words of a class, id or role that make an article's text less likely.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead cookie cookies consent gdpr notice banner popup modal overlay newsletter subscribe signup share sharing social comment comments "
    "disqus respond reply replies related recommended widget login search pagination pager toolbar contentinfo complementary".split()
)
#: A name with one of these words says that something is not there.
DENIED = frozenset("no not without has hide hidden".split())
PENALTY = 10
#: Densities of at least this share of another agree with it.
AGREES = 0.25
#: A form with more than this share of a page's characters is the page.
MOST = 0.5
MAX_DEPTH = 512
#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that group others, whatever they are used for.
CONTAINERS = frozenset("article aside div fieldset figure footer form header main nav ol section table ul".split())
LISTS = frozenset("ol table ul".split())
#: An open element of the second kind ends where one of the first begins.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
} | {x: {"p"} for x in BLOCKS - {"body", "html", "li", "dt", "dd", "tr", "td", "th"}}
#: Such ends are not looked for beyond these.
SCOPE = frozenset("html body table ul ol dl article section main div".split())
WORDS = re.compile(r"[a-z0-9]+")
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />]*")
#: An attribute's name and what leads to its value; each match goes on where the last one ended.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
COMMENT_END = re.compile(r"--!?>")
UNQUOTED = re.compile(r"[^\s>]*")
#: Numeric references of so many digits that only leading zeros can make them one of a character.
LONG_NUMBER = re.compile(r"&#(?:(?P<ten>[0-9]{8,})|[xX](?P<hex>[0-9a-fA-F]{8,}));?")


def unescaped(text: str) -> str:
    """Character references decoded, those of any length."""
    if "&" not in text:
        return text

    def number(m: re.Match) -> str:
        kind = "x" if m["hex"] else ""
        digits = (m["hex"] or m["ten"]).lstrip("0") or "0"
        return f"&#{kind}{digits};" if len(digits) < 8 else "\ufffd"

    return html.unescape(LONG_NUMBER.sub(number, text))


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "unlikely", "depth", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "main")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, unlikely: bool):
        self.tag, self.parent, self.dropped, self.unlikely = tag, parent, dropped, unlikely
        self.depth: int = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best = self
        self.main: Node | None = None  # the child that holds most of the text, if it is a container

    def inner(self) -> Iterator[Node]:
        return (c for c in self.children if type(c) is not str and not c.dropped)

    def up(self) -> Iterator[Node]:
        """The node and all around it but the page."""
        n = self
        while n.parent is not None:
            yield n
            n = n.parent


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)


def _unlikely(attrs: list[tuple[str, str | None]]) -> bool:
    names = [set(WORDS.findall(name)) for k, v in attrs if k in ("class", "id", "role") and v for name in v.lower().split()]
    return any(not UNLIKELY.isdisjoint(n) and DENIED.isdisjoint(n) for n in names)


class Page:
    """Builds the tree; nodes are listed parents first.

    Markup is read in one pass, as browsers do: no step goes back, and what is not found ahead
    once is not looked for again. A tag, comment or quoted value without an end takes the rest of the page,
    except that a quote nowhere closed is part of an unquoted value."""

    def __init__(self, source: str):
        self.root = self.at = Node("#page", None, False, False)
        self.nodes = [self.root]
        self.open: Counter[str] = Counter()
        self.flat: Counter[str] = Counter()  # open elements that were too deep to be nested
        self.source = source
        self.missing: set[str] = set()  # quotes that do not come any more
        self._read()

    def _read(self) -> None:
        source, at, size = self.source, 0, len(self.source)
        while at < size:
            tag = source.find("<", at)
            if tag < 0:
                tag = size
            if tag > at:
                self.handle_data(unescaped(source[at:tag]))
            at = tag + 1
            if at >= size:
                if tag < size:
                    self.handle_data("<")
                return
            if name := NAME.match(source, at):
                at = self._start(name[0].lower(), name.end())
            elif source[at] == "/" and at + 1 < size:
                name = NAME.match(source, at + 1)
                at = self._past(">", at + 1)
                if name and at <= size:
                    self.handle_endtag(name[0].lower())
            elif source.startswith("!--", at):
                if source.startswith((">", "->"), at + 3):
                    at = self._past(">", at + 3)
                else:
                    end = COMMENT_END.search(source, at + 3)
                    if not end:
                        return
                    at = end.end()
            elif source[at] in "!?":
                at = self._past(">", at)
            else:
                self.handle_data("<")

    def _past(self, what: str, at: int) -> int:
        end = self.source.find(what, at)
        return end + len(what) if end >= 0 else len(self.source) + 1

    def _start(self, tag: str, at: int) -> int:
        """Reads a start tag's attributes; where it ends."""
        source, attrs = self.source, []
        while m := ATTRIBUTE.match(source, at):
            name, at, value = m[1].lower(), m.end(), None
            if m[2]:
                quote = source[at : at + 1]
                end = source.find(quote, at + 1) if quote in ("'", '"') and quote not in self.missing else -1
                if end >= 0:
                    value, at = source[at + 1 : end], end + 1
                else:
                    if quote in ("'", '"'):
                        self.missing.add(quote)
                    value = UNQUOTED.match(source, at)[0]
                    at += len(value)
            if name in ("class", "id", "role", "hidden", "aria-hidden"):
                attrs.append((name, unescaped(value) if value else value))
        at = self._past(">", at)
        if at > len(source):
            return at
        self.handle_starttag(tag, attrs)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = self._past(">", end.end()) if end else len(source)
            self.handle_endtag(tag)
        return at

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.open[tag]:
            return
        ends = CLOSES.get(tag, ())
        if any(self.open[e] for e in ends):
            for n in self.at.up():
                if n.tag in ends:
                    self._leave(n)
                    break
                if n.tag in SCOPE:
                    break
        at = self.at
        afresh = tag in ("article", "main") and not _unlikely(attrs)
        own_header = tag == "header" and any(n.tag in ("article", "main") for n in at.up())
        node = Node(tag, at, at.dropped or tag in DROPPED or (tag == "header" and not own_header) or _hidden(attrs), not afresh and (at.unlikely or _unlikely(attrs)))
        at.children.append(node)
        self.nodes.append(node)
        if tag in VOID:
            return
        if node.depth >= MAX_DEPTH:
            self.flat[tag] += 1
            return
        self.open[tag] += 1
        self.at = node

    def handle_endtag(self, tag):
        if self.flat[tag]:
            self.flat[tag] -= 1
            return
        if not self.open[tag]:
            return
        for n in self.at.up():
            if n.tag == tag:
                self._leave(n)
                return
            if n.tag in SCOPE and tag not in BLOCKS:
                return

    def handle_data(self, data):
        if not self.at.dropped:
            self.at.children.append(data)

    def _leave(self, node: Node) -> None:
        for n in self.at.up():
            self.open[n.tag] -= 1
            if n is node:
                break
        self.at = node.parent


def _count(page: Page) -> Node:
    """Sums of characters and tags from the leaves up; the body."""
    for n in page.nodes:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
    for n in reversed(page.nodes):
        if n.dropped:
            continue
        n.chars += sum(len(c.strip()) for c in n.children if type(c) is str)
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.parent is not None:
            up = n.parent
            up.chars, up.tags = up.chars + n.chars, up.tags + n.tags + 1
            up.link_chars, up.link_tags = up.link_chars + n.link_chars, up.link_tags + n.link_tags
    return next((n for n in page.nodes if n.tag == "body"), page.root)


def _cut_forms(page: Page, body: Node) -> bool:
    """Cut off forms that do not hold most of the page; whether there were any."""
    cut = False
    for n in page.nodes:  # parents first
        form = n.tag == "form" and n.chars <= MOST * body.chars
        if not n.dropped and (form or (n.parent is not None and n.parent.dropped)):
            n.dropped = cut = True
    return cut


def _densities(page: Page) -> Node:
    """Densities, their sums and each subtree's node of the greatest sum; the body."""
    body = _count(page)
    if _cut_forms(page, body):
        body = _count(page)
    ratio = body.link_chars / max(1, body.chars)
    for n in reversed(page.nodes):
        if n.dropped or not n.chars:
            continue
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c / max(1, c - n.link_chars) * lc + ratio * c + math.e)
        n.density = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(base)
        if n.unlikely:
            n.density /= PENALTY
        up = n.parent
        if up is not None and n.tag in CONTAINERS and not n.unlikely and n.chars > MOST * up.chars:
            up.main = n
        if n.total >= n.best.total:  # of equals the outer one
            n.best = n
        if up is not None:
            up.total += n.density
            if n.best.total >= up.best.total or up.best is up:  # of equals the first: nodes come last to first
                up.best = n.best
    return body


def _widened(node: Node, body: Node) -> Node:
    """The nearest article or main element around a node, or if there is none the nearest container of one
    that is none, if that is about as dense or holds most of the page's text; else the node."""
    around = next((n for n in node.up() if n.tag in ("article", "main")), None)
    around = around or next((n for n in node.up() if n.tag in CONTAINERS and n.tag not in LISTS), node)
    return around if around.density >= AGREES * node.density or around.chars > MOST * body.chars else node


def _beside(n: Node) -> bool:
    """Whether a container is less dense than one beside it that holds most of what both are in: a
    menu, an imprint, a notice around the text; or whether it is mostly links in a node that is not."""
    main, around = n.parent.main, n.parent
    if n.tag not in CONTAINERS or n.tag in ("article", "main") or main is n:
        return False
    links = n.tag not in LISTS and n.link_chars > MOST * n.chars and around.link_chars <= MOST * around.chars
    return links or (main is not None and n.density < main.density)


def _blocks(node: Node, threshold: float) -> Iterator[str]:
    """The subtree's text, block by block, white space in a block as one space; without
    penalised parts that are less dense than the threshold or than what they are in."""
    parts: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if type(x) is str:
            parts.append(x)
            continue
        if x is None or x.tag in BLOCKS:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                yield text
        elif x.tag == "br":
            parts.append(" ")
        if x is None or x.dropped or (x is not node and x.unlikely and not node.unlikely and x.density < max(threshold, AGREES * node.density)):
            continue
        if x is not node and _beside(x):
            continue
        if x.tag in BLOCKS:
            stack.append(None)
        stack.extend(reversed(x.children))
    text = " ".join("".join(parts).split())
    if text:
        yield text


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    body = _densities(page)
    if not body.chars:
        return ""
    best = body.best
    threshold = min((n.density for n in best.up() if n.depth >= body.depth), default=0.0)
    path, chosen = {*best.up()}, set()
    stack = [body]
    while stack:
        n = stack.pop()
        if n.chars and n.density >= threshold and (n in path or n.best.total >= AGREES * best.total or n.density >= best.density):
            chosen.add(id(_widened(n.best, body)))
        stack.extend(n.inner())
    out, stack = [], [body]
    while stack:  # in page order; a chosen node covers what is chosen below it
        n = stack.pop()
        if id(n) in chosen:
            out.extend(_blocks(n, threshold))
        else:
            stack.extend(reversed(list(n.inner())))
    return "\n\n".join(out)


def _extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(h) for h in pages], dtype=object)


def with_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """The rows with the main text of their pages in column ``out``."""
    return pages.withColumn(out, F.pandas_udf(_extracted, "string")(F.col(html)))

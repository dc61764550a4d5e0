"""HTML as a flat list of text blocks, each with its words, links and surroundings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Elements whose text is never shown as text of the page.
SKIPPED = frozenset("script style title textarea template noscript select iframe object svg math"
                    " audio video canvas datalist".split())
# Of those, the ones in which no other element can begin.
RAW = frozenset("script style title textarea iframe noscript".split())
# Elements that hold blocks, and blocks that hold text.
CONTAINERS = frozenset(
    "html body div section article main nav header footer aside form ul ol dl table thead tbody"
    " tfoot tr figure blockquote details dialog menu fieldset center hgroup address search".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption summary legend label"
                   " option button hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BESIDE = frozenset("nav footer aside form dialog menu button label legend search".split())
MAIN_ROLES = frozenset({"main", "article"})
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert"
                         " alertdialog form menu menubar toolbar".split())
# Words of class and id attributes that mark what stands beside the article.
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion"
    " banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup signin login comment comments commentlist disqus reply replies"
    " respond sidebar widget widgets related recommended recommendations share sharing social"
    " breadcrumb breadcrumbs nav navbar navigation menu footer masthead topbar copyright legal"
    " disclaimer toolbar pagination pager paywall toc".split())
MAIN_WORDS = frozenset("article articlebody content entry post story".split())

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    heading: bool
    in_main: bool
    beside: bool

    @property
    def link_density(self) -> float:
        return self.link_words / self.words


@dataclass
class _Open:
    """An element that is open, and what holds inside it."""

    name: str
    in_main: bool = False
    beside: bool = False
    labelled: bool = False


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    inside: list[_Open] = field(default_factory=lambda: [_Open("")])
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    block: _Open | None = None
    link_depth: int | None = None

    def text(self, raw: str) -> None:
        piece = unescape(raw) if "&" in raw else raw
        self.pieces.append(piece)
        if self.link_depth is not None:
            self.linked.append(piece)

    def close_block(self) -> None:
        words = "".join(self.pieces).split()
        if words:
            state = self.block or self.inside[-1]
            self.blocks.append(Block(
                " ".join(words), len(words), len(" ".join(self.linked).split()),
                state.name in HEADINGS, state.in_main, state.beside,
            ))
        self.pieces, self.linked, self.block = [], [], None

    def _state(self, name: str, attributes: str) -> _Open:
        outer = self.inside[-1]
        in_main, beside = outer.in_main, outer.beside
        main = name in ("article", "main")
        aside = name in BESIDE or (name == "header" and not in_main)
        if attributes:
            for match in _ATTRIBUTE.finditer(attributes):
                key = match[1].lower()
                value = match[2] or match[3] or match[4] or ""
                if key in ("class", "id"):
                    parts = {part.lower() for part in _PART.findall(value)}
                    aside |= not parts.isdisjoint(BESIDE_WORDS)
                    main |= not aside and not parts.isdisjoint(MAIN_WORDS)
                elif key == "role":
                    main |= value.lower() in MAIN_ROLES
                    aside |= value.lower() in BESIDE_ROLES
                elif key == "hidden" or (key == "style" and re.search(
                        r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                    aside = True
        if name in ("html", "body", "main", "article"):
            # Their classes say what kind of page it is.
            aside = False
        return _Open(name, (in_main or main) and not aside, beside or aside)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.pieces.append(" ")
        elif name == "a":
            self.link_depth = len(self.inside)
        elif name in CONTAINERS:
            self.close_block()
            self.inside.append(self._state(name, attributes))
        elif name in BLOCKS:
            self.close_block()
            self.block = self._state(name, attributes)

    def end(self, name: str) -> None:
        if name == "a":
            self.link_depth = None
        elif name in BLOCKS:
            self.close_block()
        elif name in CONTAINERS:
            self.close_block()
            for depth in range(len(self.inside) - 1, 0, -1):
                if self.inside[depth].name == name:
                    del self.inside[depth:]
                    if self.link_depth is not None and self.link_depth > depth:
                        self.link_depth = None
                    break


def _skip(html: str, at: int, name: str, lower: str) -> int:
    """The place after the element ``name`` that was opened before ``at``."""
    depth = 1
    while depth:
        end = lower.find("</" + name, at)
        if end < 0:
            return len(html)
        if name not in RAW:
            inner = lower.count("<" + name, at, end)
            depth += inner
        depth -= 1
        close = html.find(">", end)
        if close < 0:
            return len(html)
        at = close + 1
    return at


def text_blocks(html: str) -> list[Block]:
    """The blocks of a page in page order; blocks without a word are left out.

    Comments, declarations and elements that show no text are skipped; character
    references are decoded; white space becomes one space. A tag or comment that never
    ends hides what follows, as in a browser; a lone ``<`` is text.
    """
    reader, at, lower = _Reader(), 0, None
    while True:
        tag = html.find("<", at)
        if tag < 0:
            reader.text(html[at:])
            break
        if tag > at:
            reader.text(html[at:tag])
        follow = html[tag + 1:tag + 3]
        if follow[:1] in "!?" and follow:
            mark = "-->" if html.startswith("<!--", tag) else ">"
            close = html.find(mark, tag + (2 if mark == ">" else 4))
            if close < 0:
                break
            at = close + len(mark)
            continue
        if not (follow[:1].isascii() and follow[:1].isalpha() or (
                follow[:1] == "/" and follow[1:].isascii() and follow[1:].isalpha())):
            reader.text("<")
            at = tag + 1
            continue
        match = _TAG.match(html, tag)
        if not match:
            break
        at = match.end()
        name = match[1].lower()
        if follow[0] == "/":
            reader.end(name)
        elif name in SKIPPED:
            if not match[2].rstrip().endswith("/") or name not in ("svg", "math"):
                lower = lower or html.lower()
                lower = lower if len(lower) == len(html) else _ascii_lower(html)
                at = _skip(html, at, name, lower)
        else:
            reader.start(name, match[2])
    reader.close_block()
    return reader.blocks


def _ascii_lower(text: str) -> str:
    """Lower case of A to Z only, which keeps every place."""
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)

"""Text blocks of a web page, with where they stand: one tolerant pass over tags and text.

Start tags close what they imply (a paragraph ends at the next block, a list item at the next one), end tags without
a start are left alone, what is never closed ends with the page. Scripts, styles, controls and hidden elements have no text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Fixed values of the markup language: elements by how they are read.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Their content is no markup and no text of the page.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
SILENT = frozenset("audio button canvas datalist head map math meter object optgroup option progress rp select svg template video".split())
IN_HEAD = frozenset("base bgsound link meta noscript script style template title basefont".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENTRIES = frozenset("li dd dt tr td th caption".split())
#: An open element of this kind ends at a start tag of the group, unless one of the others was opened inside.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
}
CELL = ("td", "th", "caption", "table")

# Marks: what names in the markup say about the part of the page.
BOILERPLATE, WEAK, NONE, LIKELY, CONTENT, NESTED = -2, -1, 0, 1, 2, 3
#: Names of parts that are no article, in class, id and role.
OTHER_PARTS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar widget widgets footer contentinfo complementary masthead toolbar "
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert alertdialog popup modal overlay toast newsletter subscribe subscription paywall share sharing social comment comments "
    "commentlist reply replies respond disqus related recommended recommendations login signin signup register search pagination pager copyright".split()
)
ARTICLE_PARTS = frozenset("article content entry post story body text main articlebody prose".split())
_UNSAID = frozenset("has with no without".split())

_TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[\s/=]|[^\s/>=]+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))?)*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*+)))?", re.S)
_TELLING = re.compile(r"class|id|role|style|hidden|itemprop|href", re.I)
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


@dataclass
class TextBlock:
    text: str
    mark: int
    #: "heading", "entry" (of a list or table) or "text"
    kind: str
    #: share of the characters inside links
    linked: float
    #: steps in the tree from the block before
    distance: int
    #: the element that holds the block and its siblings
    family: int


def _attributes(text: str) -> dict[str, str]:
    if not text or not _TELLING.search(text):
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    style = "".join(attributes.get("style", "").lower().split())
    return "display:none" in style or "visibility:hidden" in style


def _names(attributes: dict[str, str]) -> set[str]:
    out = set()
    for key in ("class", "id", "role", "itemprop"):
        for word in attributes.get(key, "").split():
            if key == "itemprop" and word.lower() != "articlebody":
                continue
            parts = [x.lower() for x in _NAME.findall(word)]
            out.update(x for k, x in enumerate(parts) if not k or parts[k - 1] not in _UNSAID)
            out.add(word.lower())
    return out


def mark_of(tag: str, attributes: dict[str, str], mark: int) -> int:
    """The mark inside an element, from the mark around it."""
    if tag in ("html", "body"):
        return mark
    names = _names(attributes) if attributes else set()
    other = bool(names & OTHER_PARTS)
    if mark == BOILERPLATE:
        # an article inside a part that only its name makes another one: settled when the whole page is known
        return NESTED if tag in ("article", "main") and not other else mark
    if other or tag in ("nav", "aside", "footer", "dialog", "menu", "search"):
        return BOILERPLATE
    if tag in ("article", "main") or names & {"main", "article", "articlebody"}:
        return mark if mark == NESTED else CONTENT
    form = tag == "form" or "form" in names
    if mark > NONE:
        return BOILERPLATE if form else mark
    if form or tag == "header" or "header" in names:
        return WEAK  # an article inside is one all the same: some pages are one form
    return LIKELY if mark == NONE and names & ARTICLE_PARTS else mark


class _Page:
    def __init__(self) -> None:
        #: open elements: (tag, is block, mark, silent, link, number, number of the block around)
        self.stack: list[tuple] = [("", True, NONE, False, False, 0, 0)]
        self.places: dict[str, list[int]] = {}
        self.block_places = [0]
        self.elements = 1
        self.blocks: list[TextBlock] = []
        self.low = 1
        self.last_depth = 1
        self._fresh()

    def _fresh(self) -> None:
        self.parts: list[str] = []
        self.linked = self.length = 0
        self.at: tuple | None = None

    def place(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, tag: str, attributes: dict[str, str]) -> None:
        _, _, mark, silent, link, number, around = self.stack[-1]
        is_block = tag in BLOCK
        if is_block:
            around, number = number, self.elements
            self.elements += 1
            self.block_places.append(len(self.stack))
            mark = mark_of(tag, attributes, mark)
        silent = silent or tag in SILENT or bool(attributes and _hidden(attributes))
        link = link or (tag == "a" and "href" in attributes)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, is_block, mark, silent, link, number, around))

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            frame = self.stack.pop()
            self.places[frame[0]].pop()
            if frame[1]:
                self.block_places.pop()
        self.low = min(self.low, len(self.block_places))

    def text(self, raw: str) -> None:
        if self.stack[-1][0] == "head" and not raw.isspace():
            self.pop_to(len(self.stack) - 1)
        frame = self.stack[-1]
        if frame[3]:
            return
        said = unescape(raw) if "&" in raw else raw
        self.parts.append(said)
        size = len(said) - said.count(" ")
        if not size:
            return
        self.length += size
        self.linked += size if frame[4] else 0
        if self.at is None and not said.isspace():
            depth = len(self.block_places)
            low = min(self.low, depth)
            self.at = (frame[2], self.stack[self.block_places[-1]][0], self.last_depth + depth - 2 * low, frame[6])

    def end_block(self) -> None:
        if self.at is not None:
            mark, tag, distance, family = self.at
            kind = "heading" if tag in HEADINGS else "entry" if tag in ENTRIES else "text"
            said = " ".join("".join(self.parts).split())
            self.blocks.append(TextBlock(said, mark, kind, self.linked / self.length, distance, family))
            self.last_depth = self.low = len(self.block_places)
        self._fresh()

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if self.stack[-1][0] == "head" and tag not in IN_HEAD:
            self.pop_to(len(self.stack) - 1)
        if tag in BLOCK:
            self.end_block()
            paragraph = self.place(("p",))
            if paragraph > self.place(CELL):
                self.pop_to(paragraph)
        if tag in IMPLIED:
            group, inside = IMPLIED[tag]
            barrier = self.place(inside)
            first = min((p for t in group for p in self.places.get(t, ())[-1:] if p > barrier), default=None)
            if first is not None:
                self.end_block() if tag not in ("td", "th") else None
                self.pop_to(first)
        if tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag == "a" and self.place(("a",)) > self.block_places[-1]:
            self.pop_to(self.place(("a",)))
        if tag not in VOID:
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        place = self.place((tag,))
        if not place or tag in ("html", "body"):
            return
        limit = self.place(CELL) if tag in BLOCK and tag not in CELL and tag not in ("tr", "tbody", "thead", "tfoot") else 0
        if tag not in BLOCK and tag not in SILENT and tag not in CELL:
            limit = self.block_places[-1]  # an inline end tag closes no block
        if place > limit:
            self.pop_to(place)


def blocks_of(html: str | None) -> list[TextBlock]:
    """The text blocks of a page in order: white space made one blank, character references decoded, none empty."""
    page = _Page()
    html = html or ""
    at = 0
    while (m := _TAG.search(html, at)) is not None:
        if m.start() > at:
            page.text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            page.end(tag)
        elif tag in RAW:
            if tag in ("textarea", "iframe"):
                page.text(" ")
            close = _CLOSE[tag].search(html, at)
            at = close.end() if close else len(html)
        else:
            page.start(tag, _attributes(m[3]))
    page.text(html[at:])
    page.end_block()
    return page.blocks

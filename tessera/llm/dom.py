"""A lenient reader of web pages: tags, comments and raw text as browsers take them, in one pass over the text.

What is open when an element starts or ends is closed by a few of HTML's rules (paragraphs by blocks, items by items,
cells by cells). Deeper than ``DEPTH`` elements nest no further, so that no page costs more than its length. Text is never lost."""

from __future__ import annotations

import html
import re

DEPTH = 128
# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: What closes when an element starts, up to the nearest of the elements after it.
_ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_WALLS = frozenset("table td th caption button object html".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?""")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Node:
    """An element: its tag, attributes and parent, and in order its children: nodes and pieces of text."""

    __slots__ = ("tag", "attributes", "parent", "children", "depth")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes from ``at``, the place behind the tag's end, and whether it ended itself."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if not m:
            break
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        at = m.end()
        if at < len(page) and page[at] in "\"'":  # a quote that never ends takes the rest of the page, others stand alone
            other = page.find(page[at], at + 1)
            at = len(page) if other < 0 else other + 1
    end = page.find(">", at)
    return (found, len(page), False) if end < 0 else (found, end + 1, page[at:end].endswith("/"))


def parse(page: str) -> Node:
    """The page's root, a node without a tag."""
    root = Node("", {}, None)
    now = root
    counts: dict[str, int] = {}  # open elements by tag
    at, size, text = 0, len(page), 0

    def say(end: int) -> None:
        if end > text:
            now.children.append(html.unescape(page[text:end]))

    def close(upto: Node) -> None:
        nonlocal now
        while True:
            counts[now.tag] -= 1
            done = now is upto
            now = now.parent
            if done:
                return

    def nearest(tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> Node | None:
        if not any(counts.get(t) for t in tags):
            return None
        node = now
        while node.parent is not None and node.tag not in walls:
            if node.tag in tags:
                return node
            node = node.parent
        return node if node.tag in tags else None

    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= size:
            break
        c = page[at + 1]
        if c == "!":
            say(at)
            if page.startswith("<!--", at):
                if page.startswith((">", "->"), at + 4):
                    end = page.find(">", at) + 1
                else:
                    m = re.compile(r"--!?>").search(page, at + 4)
                    end = m.end() if m else size
            else:
                end = page.find(">", at) + 1 or size
            at = text = end
        elif c == "?" or (c == "/" and not page[at + 2 : at + 3].isalpha()):
            say(at)
            at = text = page.find(">", at) + 1 or size
        elif c == "/":
            say(at)
            name = _NAME.match(page, at + 2)
            tag = name[0].lower()
            at = text = _attributes(page, name.end())[1]
            if tag == "br":
                now.children.append(Node("br", {}, now))
            elif counts.get(tag):
                walls = frozenset() if tag not in INLINE else frozenset(("p", "div", "td", "th", "li", "article", "section", "body"))
                node = now
                while node.tag != tag and node.parent is not None and node.tag not in walls:
                    node = node.parent
                if node.tag == tag:
                    close(node)
        elif c.isalpha() and c.isascii():
            say(at)
            name = _NAME.match(page, at + 1)
            tag = name[0].lower()
            attributes, at, itself = _attributes(page, name.end())
            text = at
            if tag in _CLOSES_P:
                p = nearest({"p"}, _WALLS)
                if p is not None:
                    close(p)
            if tag in _ENDED_BY:
                while (old := nearest(*_ENDED_BY[tag])) is not None:
                    close(old)
            if tag in ("html", "body") and counts.get(tag):
                continue
            node = Node(tag, attributes, now)
            now.children.append(node)
            if tag in RAW:
                m = _RAW_ENDS[tag].search(page, at)
                end = m.start() if m else size
                node.children.append(page[at:end])
                at = text = (page.find(">", end) + 1 or size) if m else size
            elif tag not in VOID and not (itself and tag in ("svg", "path")) and node.depth < DEPTH:
                counts[tag] = counts.get(tag, 0) + 1
                now = node
        else:
            at += 1
    say(size)
    return root

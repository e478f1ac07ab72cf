"""Main texts of web pages by site style trees.

Each page is read into a tree of its block elements, from which what says of itself that it is no article (scripts, forms,
menus, adverts, comments and the like, by tag, role or class) is cut. The pages of one host are then merged into the host's
style tree: a node is a place, known by the tags, classes and sibling sequences from the root down to it (runs of equal paragraphs, items or
cells are one place); its style nodes are the sequences of children seen there, its content features the texts. With m pages
at a node, a style or text that n of them have carries an entropy of log n / log m: 1 where all pages have it, 0 where it is one
page's own. A node's importance joins the entropy of its styles, which is high where pages differ, with the importance of
all content below, every text once and weighed by its length, and the first counts for 1 - ``GAMMA`` ** (number of styles). Branches
less important than ``LEAST`` go from each page. Where a page marks its article (article, main), what lies outside goes too.

Only hashes are shuffled to build the trees: pages with the same content are counted once, so that copies of an article do
not make it a template; counts are combined before they travel, so a host with a third of all pages is many
rows of (host, node, text) and no group. A node seen on fewer than ``PAGES`` pages is important. Pages get back the nodes
that go, never a host's tree.

Defined results: null html is empty; a page without text gives an empty text; pages without a host have no tree; a page that would
lose everything keeps what its own marks leave, and of a marked article that goes as a whole nothing goes (pages of a host may all be near copies); repeated rows and equal page_ids
give a row each; other columns are ignored. White space is that of Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, numbered
from .dom import INLINE, VOID, Node, parse

GAMMA, LEAST, PAGES = 0.9, 0.5, 4
#: Copies of the table of nodes that go, where it is too large to be broadcast.
SALTS = 16

# fixed values: elements and roles that are no part of an article
_NEVER = frozenset("applet area aside audio button canvas command datalist dialog embed footer frameset head iframe input keygen map menu menuitem meter nav noembed noframes noscript object optgroup option output progress script search select style svg template textarea title video".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search searchbox status tablist toolbar".split())
# fixed values: words of classes and ids that mark what is no part of an article
_WORDS = frozenset(
    "ad ads adbox adcontainer adsense adslot adspace adunit adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline comment commentary commentlist "
    "comments consent cookie cookiebar cookies copyright disclaimer discussion disqus feedback foot footer form gdpr hidden legal login masthead menu menubar message modal "
    "mpu nav navbar navi navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommendations recommended related "
    "remark replies reply respond responses rail search share sharebar sharing sidebar signup skip skyscraper social sponsor sponsored sponsors subnav subscribe subscription taboola tagcloud "
    "teaser teasers toolbar topbar tracking trending widget widgets".split()
)
_UNLESS = frozenset("has no not open show with without".split())
_ARTICLE_WORDS = frozenset("article entry post story title content".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# fixed values: headings of what follows an article, in the languages of the pages
_AFTER = re.compile(
    r"(?:\d+\s+)?(?:reader\s+|leser)?(?:comments?|kommentare?|commentaires?|comentarios?|responses?|discussion|diskussion)(?:\s*\(?\d+\)?)?:?"
    r"|(?:leave|post|write|add) a (?:comment|reply)|(?:related|recommended)(?: (?:articles|posts|stories|news|content))?|you may also like|more (?:stories|articles)|read more|advertisements?|anzeige|publicité|publicidad",
    re.IGNORECASE,
)
#: Elements whose repetitions are one place.
_RUNS = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption option hr #".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend".split())


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit((url or "").strip()).hostname or None
    except ValueError:
        return None


def _words(node: Node) -> list[str]:
    return [w.lower() for name in ("class", "id") for part in node.attributes.get(name, "").split() for w in _marks(part)]


def _marks(name: str) -> list[str]:
    words = _WORD.findall(name)
    return [w for k, w in enumerate(words) if k == 0 or words[k - 1].lower() not in _UNLESS]


def _hidden(node: Node) -> bool:
    return "hidden" in node.attributes or "display:none" in node.attributes.get("style", "").replace(" ", "").lower()


class Page:
    """A page's blocks of text in order, each at a node; a node's key, parent and style, and whether it lies in the marked article."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.at: list[int] = []
        self.keys: list[int] = []
        self.ups: list[int] = []
        self.styles: list[int] = []
        self.inside: list[bool] = []
        root = parse(page)
        order = self._order(root)
        self.length = self._lengths(order)
        self.cut_: set[int] = set()
        self._mark(order)
        self._place(root)

    def _order(self, root: Node) -> list[Node]:
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
        return order

    def _lengths(self, order: list[Node]) -> dict[int, tuple[int, int]]:
        """Characters of text below each node that may be read, and those of them in links."""
        own: dict[int, tuple[int, int]] = {}
        for node in reversed(order):
            n = links = 0
            if node.tag not in _NEVER:
                for c in node.children:
                    if isinstance(c, Node):
                        a, b = own[id(c)]
                        n, links = n + a, links + b
                    else:
                        n += len("".join(c.split()))
                if node.tag == "a":
                    links = n
            own[id(node)] = (n, links)
        return own

    def _mark(self, order: list[Node]) -> None:
        whole = self.length[id(order[0])][0]
        holds: set[int] = set()  # nodes that hold an article or main heading
        for node in reversed(order):
            body = node.tag in ("article", "main") and not _WORDS.intersection(_words(node))
            if body or any(isinstance(c, Node) and id(c) in holds for c in node.children):
                holds.add(id(node))
        gone = self.cut_
        inside: dict[int, bool] = {}
        marked, titles = [], []
        for node in order:
            up = node.parent
            if up is not None and id(up) in gone:
                gone.add(id(node))
                continue
            inner = inside[id(node)] = node.tag in ("article", "main") or (up is not None and inside.get(id(up), False))
            if self._foreign(node, inner, whole, id(node) in holds):
                gone.add(id(node))
            elif node.tag in ("article", "main") or node.attributes.get("itemprop") == "articleBody" or node.attributes.get("role") in ("main", "article"):
                marked.append(node)
            elif node.tag == "h1":
                titles.append(node)
        articles = [n for n in marked if n.tag == "article" and self.length[id(n)][0]] or [n for n in marked if self.length[id(n)][0]]
        self.marked = {id(n) for n in articles}
        if articles and articles[0].tag == "article":  # a main part's own title
            self.marked |= {id(n) for n in titles if self._below(n, "main")}

    def _below(self, node: Node, tag: str) -> bool:
        while node is not None and node.tag != tag:
            node = node.parent
        return node is not None

    def _foreign(self, node: Node, inner: bool, whole: int, holds: bool) -> bool:
        tag = node.tag
        if tag in _NEVER:
            return True
        if tag in ("", "html", "body"):
            return False
        n, links = self.length[id(node)]
        main = holds or (2 * n > whole and tag not in INLINE and not inner and any(isinstance(c, Node) and c.tag == "p" for c in node.children))
        if holds and tag not in ("article", "main"):
            return False
        if _hidden(node) or node.attributes.get("role", "").lower() in _ROLES and not main:
            return True
        if tag in ("form", "fieldset"):
            return not main and (2 * n <= whole or not self._count(node, "p"))
        if tag == "header" and not inner:
            return True
        words = _words(node)
        if _WORDS.intersection(words) and not (main and tag != "article"):
            return not holds or tag == "article"
        if "header" in words and not inner and not main and not _ARTICLE_WORDS.intersection(words):
            return True
        if tag in INLINE or tag in VOID:
            return False
        if not inner and not main and n and 10 * links > 7 * n and tag not in ("p", "li", "td", "tr", *_HEADINGS) and self._count(node, "a") > 2:
            return True  # a list of links
        if tag in ("section", "div", "ol", "ul", "dl"):
            first = self._heading(node)
            return bool(first and _AFTER.fullmatch(first))
        return False

    def _count(self, node: Node, tag: str) -> int:
        stack, n = [node], 0
        while stack and n < 3:
            x = stack.pop()
            n += x.tag == tag
            stack.extend(c for c in x.children if isinstance(c, Node))
        return n

    def _heading(self, node: Node) -> str | None:
        """The heading that a section starts with."""
        for c in node.children:
            if isinstance(c, str):
                if c.strip():
                    return None
            elif c.tag in _HEADINGS or c.tag == "header":
                said, stack = [], [c]
                while stack:
                    x = stack.pop()
                    if isinstance(x, str):
                        said.append(x)
                    else:
                        stack.extend(reversed(x.children))
                return " ".join("".join(said).split())
            elif self.length[id(c)][0]:
                return None
        return None

    def _sequence(self, node: Node) -> list[tuple[str, Node | list]]:
        """The blocks and texts under a block element; inline elements are read through."""
        out: list[tuple[str, Node | list]] = []
        text: list[str] = []

        def flush() -> None:
            said = " ".join("".join(text).split())
            if said:
                out.append(("#", said))
            text.clear()

        stack = [iter(node.children)]
        while stack:
            c = next(stack[-1], None)
            if c is None:
                stack.pop()
            elif isinstance(c, str):
                text.append(c)
            elif id(c) in self.cut_:
                text.append(" ")
            elif c.tag in ("br", "wbr"):
                text.append(" " if c.tag == "br" else "")
            elif c.tag in INLINE:
                stack.append(iter(c.children))
            elif c.tag not in VOID:
                flush()
                out.append((f"{c.tag} {' '.join(sorted(re.sub('[0-9]+', '', c.attributes.get('class', '')).split()))} {c.attributes.get('role', '')}", c))
            elif c.tag == "hr":
                flush()
        flush()
        return out

    def _place(self, root: Node) -> None:
        known: dict[tuple[int, bool], int] = {}
        self.seen_styles: set[tuple[int, int]] = set()

        def new(key: int, up: int, inside: bool) -> int:
            k = known.get((key, inside))
            if k is None:
                k = known[key, inside] = len(self.keys)
                self.keys.append(key)
                self.ups.append(up)
                self.inside.append(inside)
            return k

        stack: list[tuple[Node | str, int]] = [(root, new(0, -1, id(root) in self.marked))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, str):
                self.texts.append(node)
                self.at.append(at)
                continue
            children = self._sequence(node)
            names, index = [], []
            for name, _ in children:
                if not (names and names[-1] == name and name.split(" ", 1)[0] in _RUNS):
                    names.append(name)
                index.append(len(names) - 1)
            style = xxhash.xxh64_intdigest("\n".join(names).encode("utf-8", "replace"))
            self.seen_styles.add((at, style))
            below = []
            for (name, c), k in zip(children, index):
                key = xxhash.xxh64_intdigest(f"{self.keys[at]} {style} {k} {name}".encode("utf-8", "replace"))
                below.append((c, new(key, at, self.inside[at] or (not isinstance(c, str) and id(c) in self.marked))))
            stack.extend(reversed(below))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kf", "kr", "page_id", "url", "host", "signature", "texts", "at", "keys", "ups", "inside", "styles", "features"]
    longs, ints, pairs = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("size", pa.int32())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), ints, longs, ints, pa.list_(pa.bool_()), pairs, pairs]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for b in batches:
        rows, size = [], 0
        for k in range(b.num_rows):
            kf, kr, page_id, url, page = (b.column(c)[k].as_py() for c in ("kf", "kr", "page_id", "url", "html"))
            p = Page((page or "").replace("\x00", "�"))
            texts = [t.encode("utf-8", "replace").decode() for t in p.texts]
            keys = [_signed(x) for x in p.keys]
            styles = [(n, _signed(s), 0) for n, s in sorted(p.seen_styles)]
            features = sorted({(n, _signed(xxhash.xxh64_intdigest(t.encode())), len(t)) for n, t in zip(p.at, texts)})
            signature = _signed(xxhash.xxh64_intdigest(repr((keys, styles, features)).encode()))
            rows.append((kf, kr, page_id, url, host_of(url), signature, texts, p.at, keys, p.ups, p.inside, styles, features))
            size += len(page or "")
            if size > 4 << 20:
                yield batch(rows)
                rows, size = [], 0
        yield batch(rows)


_READ = (
    "kf long, kr long, page_id long, url string, host string, signature long, texts array<string>, at array<int>, keys array<bigint>, ups array<int>, inside array<boolean>, "
    "styles array<struct<node:int,hash:bigint,size:int>>, features array<struct<node:int,hash:bigint,size:int>>"
)


def _ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page (host, styles, features, keys, ups): rows (host, key, kind, hash, size, above), kind 0 for a style with the node's ancestors, 1 for a text."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for host, keys, ups, styles, features in zip(*(b.column(c).to_pylist() for c in ("host", "keys", "ups", "styles", "features")), strict=True):
            above: list[list[int]] = []
            for key, up in zip(keys, ups, strict=True):
                above.append([*above[up], key] if up >= 0 else [key])
            styled = {s["node"] for s in styles}
            found = [(s["node"], 0, s["hash"], 0) for s in styles] + [(n, 0, 0, 0) for n in range(len(keys)) if n not in styled] + [(f["node"], 1, f["hash"], f["size"]) for f in features]
            for n, kind, h, size in found:
                for column, value in zip(out, (host, keys[n], kind, h, size, above[n] if kind == 0 else None)):
                    column.append(value)
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["host", "key", "kind", "hash", "size", "above"])


def style_trees(read: DataFrame) -> DataFrame:
    """The merged nodes of each host that ``PAGES`` or more different pages have: (host, key, pages, importance)."""
    different = read.where(F.col("host").isNotNull() & (F.size("at") > 0)).select("host", "signature", "keys", "ups", "styles", "features").dropDuplicates(["host", "signature"])
    rows = different.select("host", "keys", "ups", "styles", "features").mapInArrow(_ancestors, "host string, key long, kind int, hash long, size long, above array<bigint>")
    counts = cut(rows.groupBy("host", "key", "kind", "hash").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.first("above").alias("above")), "style-counts")
    # a run's elements may have several styles on a page: their place then counts more pages than it has, and is the more important for it
    log_n = F.log(F.col("n").cast("double"))
    styles = counts.where("kind = 0").groupBy("host", "key").agg(F.sum("n").alias("pages"), F.count("*").alias("styles"), F.sum(F.col("n") * log_n).alias("s"), F.first("above").alias("above"))
    texts = counts.where("kind = 1").groupBy("host", "key").agg(F.sum("size").alias("size"), F.sum(F.col("size") * log_n).alias("held"))
    nodes = styles.join(texts, ["host", "key"], "left")
    log_m = F.log(F.greatest("pages", F.lit(2)).cast("double"))
    own = F.coalesce(F.col("size") - F.least(F.col("held") / log_m, F.col("size").cast("double")), F.lit(0.0))
    below = nodes.where("size > 0").select("host", F.explode("above").alias("key"), own.alias("own"), "size").groupBy("host", "key").agg(F.sum("own").alias("own"), F.sum("size").alias("all"))
    style = (F.log(F.col("pages").cast("double")) - F.col("s") / F.col("pages")) / log_m
    weight = F.pow(F.lit(GAMMA), F.col("styles").cast("double"))
    joined = nodes.where(F.col("pages") >= PAGES).drop("size").join(below, ["host", "key"])
    importance = (1 - weight) * style + weight * F.col("own") / F.col("all")
    return joined.select("host", "key", "pages", importance.alias("importance"))


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of pages that are left without the branches that go."""
    for b in batches:
        out = []
        for texts, at, keys, ups, inside, gone in zip(*(b.column(c).to_pylist() for c in ("texts", "at", "keys", "ups", "inside", "gone")), strict=True):
            gone = set(gone or ())
            marked = any(inside)
            noisy: list[bool] = []
            whole: list[bool] = []  # inside a marked article that would go as a whole
            for key, up, i in zip(keys, ups, inside, strict=True):
                if i and not inside[up]:  # the marked article
                    whole.append(key in gone)
                    noisy.append(False)
                else:
                    whole.append(up >= 0 and whole[up])
                    noisy.append(not whole[-1] and (key in gone or (up >= 0 and noisy[up])))
            kept = [(t, noisy[n]) for t, n in zip(texts, at) if inside[n] or not marked]
            left = [t for t, n in kept if not n] or [t for t, _ in kept]
            out.append("\n\n".join(left))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) of the pages (page_id, url, html)."""
    keyed = numbered(pages.select("page_id", "url", "html"), "key")
    rows = keyed.select(F.col("key.file").alias("kf"), F.col("key.row").alias("kr"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    read = cut(rows.mapInArrow(_read, _READ), "pages-read")
    noisy = cut(style_trees(read).where(F.col("importance") < LEAST).select("host", "key"), "noisy")
    few = bounded(noisy)
    if few is not noisy:  # each page takes all that go of its host
        text = read.join(F.broadcast(few.groupBy("host").agg(F.collect_list("key").alias("gone"))), "host", "left")
    else:  # too many to be broadcast: each page gets its own
        salted = noisy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        places = read.where("host is not null").select("kf", "kr", "host", F.explode("keys").alias("key"), F.pmod(F.xxhash64("kr", "kf"), F.lit(SALTS)).cast("int").alias("salt"))
        gone = places.join(salted, ["host", "key", "salt"], "left_semi").groupBy("kf", "kr").agg(F.collect_set("key").alias("gone"))
        text = read.join(gone, ["kf", "kr"], "left")
    text = text.select("page_id", "url", "texts", "at", "keys", "ups", "inside", "gone")
    out = text.mapInArrow(_written, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))

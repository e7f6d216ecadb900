"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Paragraphs, and text that stands in a container directly, pass points for length and commas
to their parent and half of them to the grandparent; a container's sum is discounted by the share of its text that is in links. The
container with the most points and those of its siblings that look like more of the same are the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import prepare

# Elements of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("script style noscript iframe template svg math object embed form button select textarea input label fieldset nav footer aside head title dialog menu xmp noembed noframes canvas audio video".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside head".split())
#: An opening tag of the first group ends an open p; li, dt, dd, tr, td, th, option end an open one of their kind.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "head"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

#: Names in class, id or role of what is never main text; a name counts by its last part, so that tag-list is one and tag-page isn't.
UNLIKELY = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|comments?|disqus|replies|respond|sidebar|side|rail|widget|related|recommend\w*|share|sharing|social|breadcrumbs?|menu|nav|navbar|navigation|topbar|toolbar|header|masthead|footer|footnav|legal|copyright|login|signup|subscribe|newsletter|search|pagination|pager|tags?|skip|hidden|complementary|contentinfo|alert", re.I)
#: Parts that say where or in what something stands, not what it is.
PLACES = re.compile(r"area|bar|block|bottom|box|button|container|fixed|form|global|group|holder|inner|item|items|large|left|link|links|list|lower|main|outer|panel|primary|region|right|row|secondary|section|slot|small|sticky|top|unit|upper|wide|wrap|wrapper|\d+", re.I)
ARTICLE = re.compile(r"(?:article|main|entry|post)[_-]?(?:body|content|text)", re.I)
LIKELY = re.compile(r"article|body|content|entry|main|page|post|text|story", re.I)

# a quote opens a value only at its beginning, and only if it is closed
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>\s+|/|=|[^\s/>=]++(?:\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>]*+))?)*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""", re.S)


def _spaced(text: str) -> str:
    return " ".join(text.split())


class Node:
    __slots__ = ("name", "attrs", "parent", "children", "points", "length", "linked")

    def __init__(self, name: str, attrs: str = "", parent: "Node | None" = None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []
        self.points, self.length, self.linked = 0.0, 0, 0

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(self.attrs)}

    def names(self) -> str:
        if not self.attrs:
            return ""
        own = self.attributes()
        return " ".join(own.get(k, "") for k in ("class", "id", "role"))


def parse(page: str) -> Node:
    """The page's tree, lenient: end tags without an open element are ignored, unclosed elements end with their parent."""
    root = at = Node("#root")
    place, n = 0, len(page)
    while place < n:
        m = _TOKEN.search(page, place)
        text = page[place : m.start()] if m else page[place:]
        if text:
            at.children.append(html.unescape(text))
        if not m:
            break
        place = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                at.children.append(Node("br"))
                continue
            x = at
            while x is not root and x.name != name and not (name not in BLOCKS and x.name in BLOCKS):
                x = x.parent
            if x is not root and x.name == name:
                at = x.parent
            continue
        if name in ENDS_P:
            x = at
            while x is not root and x.name != "p" and x.name not in BLOCKS:
                x = x.parent
            if x.name == "p":
                at = x.parent
        if name in SIBLINGS:
            x = at
            while x is not root and x.name not in SIBLINGS[name] and x.name not in SCOPES[name]:
                x = x.parent
            if x is not root and x.name in SIBLINGS[name]:
                at = x.parent
        node = Node(name, m[3] or "", at)
        at.children.append(node)
        if name in RAW:
            if re.search(r"(?:^|\s)/$", m[3] or ""):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, place)
            node.children.append(page[place : end.start() if end else n])
            place = end.end() if end else n
        elif name not in VOID:
            at = node
    return root


def _unlikely(names: str) -> bool:
    for name in names.split():
        parts = [x for x in re.split(r"[_-]+", name) if x]
        while len(parts) > 1 and PLACES.fullmatch(parts[-1]):
            parts.pop()
        if parts and UNLIKELY.fullmatch(parts[-1]) and not ARTICLE.search(name):
            return True
    return False


def _dropped(node: Node, by_name: bool) -> bool:
    if node.name in DROPPED:
        return True
    if node.name == "header" and not any(isinstance(c, Node) and c.name in ("h1", "h2") for c in node.children):
        return True
    if not node.attrs:
        return False
    own = node.attributes()
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True
    return by_name and node.name not in ("html", "body", "article", "main") and _unlikely(node.names())


def _prune(root: Node, by_name: bool) -> list[Node]:
    """Drop what is never main text; the rest in page order, parents before children."""
    order, wait = [], [root]
    while wait:
        node = wait.pop()
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not _dropped(c, by_name)]
        wait.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return order


def _measure(order: list[Node]) -> None:
    for node in reversed(order):
        own = sum(len(_spaced(c)) for c in node.children if isinstance(c, str))
        node.length = own + sum(c.length for c in node.children if isinstance(c, Node))
        node.linked = node.length if node.name == "a" else sum(c.linked for c in node.children if isinstance(c, Node))


def _inline(node: Node) -> bool:
    return node.name not in BLOCKS and node.name != "#root"


def _score(order: list[Node]) -> None:
    for node in order:
        if _inline(node):
            continue
        # a paragraph is the text of a p, pre, blockquote or td, or what a container has outside of its blocks
        text = "".join(_flat(node))
        size = len(_spaced(text))
        if size < 20:
            continue
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(size / 100, 3)
        takers = (node.parent, node.parent.parent if node.parent else None) if node.name in ("p", "pre", "blockquote", "td", "li") else (node, node.parent)
        for share, taker in zip((1, 0.5), takers):
            if taker is not None and taker.name != "#root":
                taker.points += points * share
    for node in order:
        names = node.names()
        if node.name in ("article", "main"):
            node.points += 25
        elif node.name in ("ul", "ol", "dl", "address", "th"):
            node.points -= 3
        if names and LIKELY.search(names):
            node.points += 10
        if node.length:
            node.points *= 1 - node.linked / node.length


def _flat(node: Node) -> Iterator[str]:
    """The text of a block, without its blocks' texts."""
    wait = list(reversed(node.children))
    while wait:
        c = wait.pop()
        if isinstance(c, str):
            yield c
        elif _inline(c):
            if c.name == "br":
                yield " "
            wait.extend(reversed(c.children))


def _blocks(node: Node) -> list[str]:
    out: list[list[str]] = [[]]
    wait: list[Node | str | None] = [node]
    while wait:
        c = wait.pop()
        if c is None:
            out.append([])
        elif isinstance(c, str):
            out[-1].append(c)
        elif c.name == "br":
            out[-1].append(" ")
        else:
            edge = not _inline(c)
            if edge:
                out.append([])
                wait.append(None)
            wait.extend(reversed(c.children))
    return [t for t in (_spaced("".join(x)) for x in out) if t]


def main_text(page: str) -> str:
    """The blocks of the main text, in page order, joined by line feeds; empty if there is none.

    Containers with unlikely names are dropped first; only a page that has nothing else is read with them.
    """
    return _best(_prune(parse(page), True)) or _best(_prune(parse(page), False))


def _best(order: list[Node]) -> str:
    _measure(order)
    _score(order)
    every = [n for n in order if not _inline(n) and n.name not in ("#root", "html", "p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "tr") and n.length]
    best = max(every, key=lambda n: n.points, default=None)
    if best is None or best.points <= 0:
        # no container with points: all that is left outside of links
        whole = order[0]
        return "\n".join(_blocks(whole)) if whole.length > 2 * whole.linked else ""
    if best.name in ("td", "tr", "tbody", "table") or best.parent is None or best.name in ("article", "main", "body"):
        kept = [best] if best.name != "article" else [n for n in best.parent.children if isinstance(n, Node) and (n is best or n.name == "article" and n.points >= 0.5 * best.points)]
    else:
        kept = []
        least = 0.2 * best.points
        for n in best.parent.children:
            if not isinstance(n, Node) or _inline(n):
                continue
            density = n.linked / n.length if n.length else 1
            alike = n.names() and n.names() == best.names() and n.name == best.name
            if n is best or n.points + (0.2 * best.points if alike else 0) >= least or n.name in ("h1", "h2") or n.name == "p" and n.length > 80 and density < 0.25:
                kept.append(n)
    return "\n".join(b for n in kept for b in _blocks(n))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with one more column, text: the page's main text; null and empty pages have an empty one.

    The whole page is read, however long, and no text is cut. Repeated rows stay, each with its text; an empty table gives
    no rows. A column of pages named text is replaced.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([main_text(x) if x else "" for x in b.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return pages.drop("text").withColumn("text", arrow_udf(run, "string")(F.col(html_col)))

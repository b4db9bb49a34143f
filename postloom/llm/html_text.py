"""HTML extraction: the main text of a page by tree scoring.

Method: the page becomes a tree; every paragraph passes points for its length and commas to
its parent (whole) and the ancestors above (halves, then thirds and so on), a container's
points are discounted by its link density, and the best container (the article or main around
it, if there is one) is kept together with siblings that score well or read like text, and with
all that lies between kept siblings and is no list of links.  Articles and mains start with more
points than others and compete with all.  Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments are taken out of the tree before, by element
and, if they can hold others, by the words of class, id and role.  Lists of links go at the edges of what is kept only:
before its first paragraph, or after its last one without a heading of their own.

Map only, one page at a time; a task holds one batch of pages.

Output of a page: its kept blocks in page order, joined by two line feeds; inside a block
character references are decoded and runs of white space become one space.

Edge cases: null or empty html gives an empty text.  Markup need not be well formed: open
elements end with their parent, stray end tags are ignored, an unfinished tag at the end is
dropped.  Rows are kept one to one (null or repeated page_id too); columns other than the
id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head script style noscript template textarea title iframe noembed noframes xmp nav header footer aside form menu "
                    "button select option input dialog object embed svg canvas audio video map".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li "
                   "main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PARAGRAPHS = frozenset("p pre blockquote li dd td div section article main body figcaption".split())
# words of class and id: never part of an article / only outside what is named as content
NEVER = re.compile(
    r"(?:^|[\s_-])(?:ad(?:s|box|unit|slot|block|sense|sbygoogle|vert\w*|\d+)?|banners?|breadcrumbs?|captcha|combx|comment\w*|consent|cookie\w*|disqus\w*|"
    r"footer\w*|footnav|gdpr|login|menu\w*|modal|nav\w*|newsletter\w*|notices?|notifications?|alerts?|pager|pagination|popup|promos?|promotions?|related\w*|"
    r"replies|reply|respond|sharing|share\w*|shoutbox|sidebar\w*|signup|skyscraper|social\w*|sponsor\w*|subscri\w*|toolbar|tooltip|topbar|widget\w*)(?=$|[\s_-])", re.I)
UNLIKELY = re.compile(r"(?:^|[\s_-])(?:community|disclaimer|discussion|extra|header|legends|masthead|meta|remark|rss|sidecol|tags?)(?=$|[\s_-])", re.I)
READERS = re.compile(r"(?:^|[\s_-])(?:comment\w*|replies|reply|respond|disqus\w*)(?=$|[\s_-])", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")  # mainNav names a nav as main-nav does
# classes that only name what surrounds, and names that are phrases
_LAYOUT = re.compile(r"(?:has|with|no|without|hide|show)[-_]\S+|\S+[-_](?:of|for|the|and|to|in|on|by|from|about)[-_]\S+", re.I)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry|main|post\w*|story|text)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WHOLE = frozenset(("article", "main"))  # kept whole if they hold the best container
KEEP_HEADER = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TEXTS = frozenset(("p", "pre", "blockquote", "td", "th", "tr", "li", "dd", "dt", "figcaption", "caption", "span", "b", "i", "em", "strong")) | KEEP_HEADER  # their names say nothing

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(?=[/A-Za-z!?])[^<]*$", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")
# an element whose start closes an open element of the same group
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}


class Node:
    __slots__ = ("tag", "hint", "parent", "children", "points", "has_points", "text_len", "link_len")

    def __init__(self, tag: str, hint: str = "", parent: Node | None = None):
        self.tag, self.hint, self.parent = tag, hint, parent
        self.children: list[Node | str] = []
        self.points, self.has_points = 0.0, False
        self.text_len = self.link_len = 0


def parse(html: str) -> Node:
    """The element tree without what is dropped by element; texts are decoded strings."""
    root = Node("#root")
    node, at, end = root, 0, len(html)
    lower = None
    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            node.children.append(unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            if html.startswith("<![CDATA[", m.start()):
                node.children.append(html[m.start() + 9 : m.end()].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1]:
            walk = node
            while walk is not None and walk.tag != tag:
                walk = walk.parent
            if walk is not None and walk.parent is not None:
                node = walk.parent
            continue
        if tag in BLOCKS or tag in DROPPED:  # a block ends an open paragraph, and what is open inside it
            walk = node
            while walk is not None and walk.tag not in ("p", "article", "div", "section", "td", "th", "li", "body", "button", "#root"):
                walk = walk.parent
            if walk is not None and walk.tag == "p":
                node = walk.parent
        if tag in _CLOSES:
            walk, stop_at = node, (*_SCOPE.get(tag, ("table",)), "#root")
            while walk.tag not in stop_at and walk.tag not in _CLOSES[tag]:
                walk = walk.parent
            while walk.tag in _CLOSES[tag]:
                node = walk.parent
                walk = node
        hint, hidden = "", False
        for a in _ATTRIBUTE.finditer(m[3]) if m[3].strip(" /\n\t") else ():
            key = a[1].lower()
            if key in ("class", "id"):
                hint += " " + unescape((a[2] or "").strip("\"'"))
            elif key == "hidden" or key == "role" and (a[2] or "").strip("\"'").lower() in ROLES:
                hidden = True
            elif key == "aria-hidden" and "true" in (a[2] or "") or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a[2] or "", re.I):
                hidden = True
        child = Node("#dropped" if hidden and tag not in VOID else tag, hint, node)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            node.children.append(child)
        elif tag in RAW:  # their content is no markup
            lower = lower if lower is not None else html.lower()
            close = lower.find(f"</{tag}", at)
            at = end if close < 0 else (lower.find(">", close) + 1 or end)
        else:
            node.children.append(child)
            if child.tag == "#dropped":
                child.hint = tag
                child.tag = tag
                child.points = -1.0
            node = child
    return root


def _unlikely(node: Node, by_hint: bool) -> bool:
    if node.points < 0 or node.tag in DROPPED:
        return not (node.tag == "header" and node.parent is not None and node.parent.tag in ("article", "main") and _has_title(node))
    if not node.hint or not by_hint or node.tag in ("html", "body", "main", "#root"):
        return False
    if node.tag in TEXTS:  # a text inside an article is part of it whatever it is called
        walk = node.parent
        while walk is not None and walk.tag not in WHOLE:
            walk = walk.parent
        if walk is not None:
            return False
    hint = _LAYOUT.sub(" ", f"{node.hint} {_CAMEL.sub(' ', node.hint)}")
    if node.tag == "article":
        return bool(READERS.search(hint))
    return bool(NEVER.search(hint) or UNLIKELY.search(hint) and not LIKELY.search(hint))


def _has_title(node: Node) -> bool:
    return any(n.tag in KEEP_HEADER for n in _post_order(node))


def prune(root: Node, by_hint: bool = True) -> None:
    """Takes out what never belongs to an article, by element and (``by_hint``) by class and id."""
    todo = [root]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _unlikely(c, by_hint)]
        todo += [c for c in node.children if isinstance(c, Node)]


def _post_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    out.reverse()
    return out


def _own_text(node: Node) -> str:
    """Text directly in this block: its strings and inline elements, not its inner blocks."""
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append(" ")
        elif c.tag not in BLOCKS:
            todo += reversed(c.children)
    return _SPACE.sub(" ", "".join(out)).strip()


def score(root: Node) -> list[Node]:
    """Points for every container; returns those that have any."""
    order = _post_order(root)
    scored = []
    for node in order:
        for c in node.children:
            if isinstance(c, str):
                node.text_len += len(c.strip())
            else:
                node.text_len += c.text_len
                node.link_len += c.text_len if c.tag == "a" else c.link_len
    for node in order:
        if node.tag not in PARAGRAPHS:
            continue
        text = _own_text(node)
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) // 100, 3)
        walk, level = (node if node.tag in ("body", "#root") else node.parent), 0
        while walk is not None and level < 5:
            if not walk.has_points:
                walk.has_points = True
                walk.points = {"article": 25.0, "main": 20.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0,
                               "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0}.get(walk.tag, 0.0) + (25.0 if LIKELY.search(walk.hint) else 0.0)
                scored.append(walk)
            walk.points += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            walk, level = walk.parent, level + 1
    for node in scored:
        node.points *= 1 - link_density(node)
    return scored


def link_density(node: Node) -> float:
    return node.link_len / node.text_len if node.text_len else 0.0


def _is_links(node: Node) -> bool:
    return node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.text_len > 0 and link_density(node) > 0.7


def _reads(node: Node) -> bool:
    """Whether a block holds text of its own that is not mostly links."""
    return node.tag in PARAGRAPHS and node.text_len > 0 and link_density(node) < 0.5 and len(_own_text(node)) >= 25


def _drop_edge_links(root: Node) -> None:
    """Takes out unnamed menus: lists of links below ``root``, outside inner articles, before its first
    paragraph, or after its last one unless a heading stands right before them."""
    order, todo = [], [root]  # in page order
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    place = {id(n): k for k, n in enumerate(order)}
    reading = [k for k, n in enumerate(order) if n is not root and _reads(n)]
    first, last = (reading[0], reading[-1]) if reading else (len(order), -1)
    todo = [root]
    while todo:
        node = todo.pop()
        kept: list[Node | str] = []
        for c in node.children:
            if isinstance(c, Node) and _is_links(c):
                before = next((x for x in reversed(kept) if isinstance(x, Node) or x.strip()), None)
                headed = isinstance(before, Node) and before.tag in KEEP_HEADER
                if place[id(c)] < first or place[id(c)] > last and not headed:
                    continue
            kept.append(c)
        node.children = kept
        todo += [c for c in kept if isinstance(c, Node) and c.tag not in WHOLE]


def _kept(root: Node) -> list[Node]:
    """The best container and those siblings that belong to it."""
    scored = score(root)
    order = list(reversed(_post_order(root)))
    body = next((n for n in order if n.tag == "body"), root)
    # without any points (short texts only) an article goes before the whole body
    best = max(scored or [n for n in order if n.tag in WHOLE and n.text_len], key=lambda n: n.points, default=None)
    if best is None or best.tag in ("html", "#root"):
        _drop_edge_links(body)
        return [body]
    points, around = best.points, best
    while around is not None and around.tag not in WHOLE:
        around = around.parent
    if around is not None:
        best = around
    elif best.tag in ("ul", "ol", "dl", "table", "tbody", "tr", "p", "blockquote", "li") and best.parent is not None and best.parent.tag != "#root":
        best = best.parent
        points = best.points
    points = max(points, best.points)
    if best.tag not in WHOLE:
        _drop_edge_links(best)
    if best.parent is None or best.tag == "body":
        return [best]
    enough = max(0.2 * points, min(10, 0.6 * points))
    near = best.parent.children
    wanted = []
    for n in near:
        if isinstance(n, str) or n is not best and _is_links(n):
            wanted.append(False)
            continue
        bonus = 0.2 * points if n.hint and n.hint == best.hint else 0.0
        text = _own_text(n) if n.tag == "p" else ""
        wanted.append(n is best or n.has_points and n.points + bonus >= enough or n.tag in KEEP_HEADER and True not in wanted or n.tag == "p" and (
            len(text) > 80 and link_density(n) < 0.25 or text != "" and link_density(n) == 0 and re.search(r"\.( |$)", text) is not None))
    # what lies between two kept ones is kept with them, lists of links aside
    first, last = wanted.index(True), len(wanted) - 1 - wanted[::-1].index(True)
    inner = Node("#kept")
    inner.children = [n for n in near[first : last + 1] if isinstance(n, str) or n is best or not _is_links(n) and (not n.text_len or link_density(n) < 0.5)]
    # a heading whose section is gone goes with it
    left = []
    for k, n in enumerate(inner.children):
        if isinstance(n, Node) and n.tag in KEEP_HEADER:
            at = next(i for i, x in enumerate(near) if x is n)
            heads = next((x for x in near[at + 1 :] if isinstance(x, Node) and x.text_len), None)
            if heads is not None and not any(x is heads for x in inner.children[k + 1 :]):
                continue
        left.append(n)
    inner.children = left
    return [inner]


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order; white space becomes one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = []
    for node in reversed(nodes):
        todo += [None, *reversed(node.children), None]
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            run.append(c)
        elif c.tag == "br":
            run.append(" ")
        elif c.tag in BLOCKS:
            flush()
            todo += [None, *reversed(c.children)]
        else:
            todo += reversed(c.children)
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    for by_hint in (True, False):  # names may mislead: without any text left, only elements decide
        root = parse(html)
        prune(root, by_hint)
        text = "\n\n".join(blocks(_kept(root)))
        if text:
            break
    return text


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(h) for h in part["html"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": part["page_id"], "url": part["url"], "text": pa.array(texts, pa.string()),
                                              "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(
        _run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

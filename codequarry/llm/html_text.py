"""Main text of web pages by composite text density.

The page is read into a tree of elements in one pass (raw-text elements, implied end
tags and unclosed elements much as browsers treat them); character references are decoded in each text by itself. Elements that
are boilerplate by their meaning (navigation, footers, asides, scripts, adverts) are cut first. Forms, labels, dialogs and elements
whose class or id is a boilerplate name go unless they hold most of the page's text outside links (then they stay, if no article
lies beside them; a form also has to hold a paragraph, heading or section). A boilerplate word in a longer class ("cookie-banner")
cuts a container that doesn't hold the densest subtree; one in a longer id, or behind "has", "no" or "with", or of
several meanings, lowers the score only and cuts a container outside the article. Headings are never cut by name. For every other element

    density = C / T * ln(C * T / (LC * LT)) / ln(1 + ln(C * LC / NC + C * LB / CB + e))

is the link-adjusted number of characters per tag, with C characters, T tags, LC link
characters, NC characters outside links and LT link tags of its subtree (each at least 1),
and LB / CB the share of link characters in the whole body. The element with the largest sum of its children's densities (of
equal ones the first in page order) holds the article; it grows to the article or main element around it, if there is one. The least
density on the path to the body is the threshold: menus (blocks of mostly short links; within the densest subtree of ``MENU``
links at least) that don't reach it go, and so do blocks of which links are a part: outside the densest subtree a quarter, inside it
a third of a container.

Defined cases: null, empty or text-free html gives ''; nothing is capped; a page without
markup is its own text; repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WHITE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg canvas title xmp".split())
RAW_TEXT = frozenset("script style textarea title xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend summary".split())
#: Start tags that end open elements: the groups of elements that each ends, in the order they are looked for.
ENDS = {"li": ("li", "p"), "dt": ("d", "p"), "dd": ("d", "p"), "tr": ("tr", "td"), "td": ("td",), "th": ("td",), "option": ("option",)}
#: The group of an element that another start tag may end, and the elements beyond which a group isn't looked for.
GROUP = {"p": "p", "li": "li", "dt": "d", "dd": "d", "tr": "tr", "td": "td", "th": "td", "option": "option"}
_WALLS = frozenset("article section div td table body html".split())
WALLS = {"p": _WALLS, "li": _WALLS | {"ul", "ol", "menu"}, "d": _WALLS | {"dl"}, "tr": {"table", "body", "html"}, "td": {"table", "tr", "body", "html"}, "option": _WALLS | {"select"}}
_NEAR = frozenset(GROUP) | frozenset().union(*WALLS.values())
DROP = frozenset("head nav footer aside button select input menu annotation annotation-xml".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | {"p", "article", "main", "section"}
FORMS = frozenset("form label dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog menu menubar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup comment comments disqus respond replies discussion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar related recommended share sharing social pagination pager widget login search".split())
#: Adverts never hold the article.
ADS = frozenset("ad ads adv advert adverts advertisement advertising".split())
#: Words of longer names that have other meanings too, or are said not to hold.
UNSURE, NEGATED = frozenset("discussion search notice login share widget social".split()), frozenset("has no with without".split())
CONTAINERS = frozenset("div section aside ul ol dl table header figure center details".split())
NAMED, SHORT_LINK, MENU = 0.25, 25, 5  # the weight of elements with a boilerplate name; characters of a link that can be one of a menu; links of a menu in the text
UNNAMED = HEADINGS | {"body", "html", "article", "main"}
_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """An element. ``near``: for each group the closest open element a start tag may end; ``paragraph``: the one that </p> ends."""

    __slots__ = ("tag", "parent", "items", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total", "named", "weight", "near", "paragraph", "marks")

    def __init__(self, tag: str, parent, drop: bool, named: int = 0):
        self.tag, self.parent, self.drop, self.items, self.named, self.weight = tag, parent, drop, [], named, 1.0
        self.near = parent.near if parent is not None else {}
        if tag in _NEAR:
            self.near = {g: x for g, x in self.near.items() if tag not in WALLS[g]}
            if tag in GROUP:
                self.near[GROUP[tag]] = self
        self.paragraph = self if tag == "p" else None if tag in BLOCK or parent is None else parent.paragraph


def _dropped(tag: str, rest: str, inside_article: bool) -> bool:
    if tag in DROP or tag == "header" and not inside_article:
        return True
    if not rest or "=" not in rest and "hidden" not in rest:
        return False
    for k, v in _ATTR.findall(rest):
        k, v = k.lower(), v.strip("\"'")
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v.lower() in ROLES:
            return True
        if k in ("class", "id") and tag not in UNNAMED and not ADS.isdisjoint(v.lower().split()):
            return True
        if k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            return True
    return False


def _named(tag: str, rest: str) -> int:
    """4 for a form or the like, 3 if a class or id is a boilerplate name, 2 if a word of a class of a container is one, 1 for other words, else 0."""
    found = 4 if tag in FORMS else 0
    if "=" in rest and tag not in UNNAMED:
        for k, v in _ATTR.findall(rest):
            k, v = k.lower(), v.strip("\"'")
            if k == "role" and v.lower() in FORMS:
                found = 4
            if k in ("class", "id"):
                for name in v.split():
                    if name.lower() in NAMES:
                        return max(found, 3)
                    words = [x.lower() for x in _PARTS.split(name)]
                    if not NAMES.isdisjoint(words):
                        sure = k == "class" and tag in CONTAINERS and words[0] not in NEGATED and not (NAMES - UNSURE).isdisjoint(words)
                        found = max(found, 2 if sure else 1)
    return found


class _Tags:
    """The tags of a page one after the other, in one pass.

    A quoted attribute value may hold ">". When a quote is never closed, this tag and all behind it end at their first ">".
    """

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end_of(self, at: int) -> int:
        """The place of the ">" that ends the tag whose attributes begin at ``at`` (the page's size if there is none)."""
        page, first = self.page, at
        while self.quotes:
            m = _MARK.search(page, at)
            if m is None:
                return len(page)
            if m.group() == ">":
                return m.start()
            close = page.find(m.group(), m.end())
            self.quotes = close >= 0
            at = close + 1
        close = page.find(">", first)
        return close if close >= 0 else len(page)

    def __iter__(self):
        """(begin, end, name, whether it is an end tag, attributes); for comments and the like the name is "", CDATA gives its text as attributes."""
        page, size, at = self.page, len(self.page), 0
        while (begin := page.find("<", at)) >= 0:
            if page.startswith("<!--", begin) or page.startswith("<![CDATA[", begin):
                mark, skip = ("-->", 4) if page[begin + 2] == "-" else ("]]>", 9)
                close = page.find(mark, begin + skip)
                at = close + 3 if close >= 0 else size
                own = page[begin + skip : close if close >= 0 else size] if skip == 9 else ""
                at = (yield begin, at, "", False, own) or at
                continue
            if page[begin + 1 : begin + 2] in ("!", "?"):
                close = page.find(">", begin)
                at = close + 1 if close >= 0 else size
                at = (yield begin, at, "", False, "") or at
                continue
            end = page.startswith("/", begin + 1)
            m = _NAME.match(page, begin + 1 + end)
            if m is None:
                at = begin + 1
                continue
            close = self.end_of(m.end())
            at = min(close + 1, size)
            at = (yield begin, at, m.group().lower(), end, page[m.end() : close]) or at


def parse(page: str) -> Node:
    """The tree of a page; text items are strings, dropped subtrees are kept empty. Time is proportional to the page's size."""
    root = Node("html", None, False)
    open_, at, size = root, 0, len(page)
    articles, body = 0, False
    scopes: list[Counter] = [Counter()]  # open elements by name since the last open article
    unclosed: set[str] = set()
    tags = iter(_Tags(page))
    move = None

    def close_to(node: Node) -> None:
        """Close ``node`` and all that is open inside it."""
        nonlocal open_, articles
        while True:
            articles -= open_.tag in ("article", "main")
            if open_.tag == "article":
                scopes.pop()
            else:
                scopes[-1][open_.tag] -= 1
            last, open_ = open_, open_.parent
            if last is node:
                return

    while True:
        try:
            begin, end, tag, ends, rest = tags.send(move)
        except StopIteration:
            break
        move = None
        if begin > at and not open_.drop:
            open_.items.append(entities.unescape(page[at:begin]))
        at = end
        if not tag:
            if rest and not open_.drop:
                open_.items.append(rest)
            continue
        if ends:
            if tag == "p":
                node = open_.paragraph
            elif tag == "article" and len(scopes) > 1 or scopes[-1][tag] or tag in ("body", "main") and any(x[tag] for x in scopes):
                node = open_
                while node.tag != tag:
                    node = node.parent
            else:
                node = None
            if node is not None:
                close_to(node)
            elif tag == "p" and not open_.drop:
                open_.items.append(Node("p", open_, False))
            continue
        if tag == "html" or tag == "body" and body:
            continue
        body = body or tag == "body"
        for group in ENDS.get(tag, ("p",) if tag in CLOSES_P else ()):
            if group in open_.near:
                close_to(open_.near[group])
                break
        node = Node(tag, open_, open_.drop or _dropped(tag, rest, articles > 0), _named(tag, rest))
        open_.items.append(node)
        if tag in VOID or rest.endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            # all up to the end tag; without one, text elements end with their parent and the others are empty
            close = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if close is not None:
                at = move = close.end()
            else:
                unclosed.add(tag)
                if tag in RAW_TEXT:
                    own = re.compile(rf"</{re.escape(open_.tag)}\s*>", re.I).search(page, at)
                    at = move = own.start() if own else size
            continue
        articles += tag in ("article", "main")
        if tag == "article":
            scopes.append(Counter())
        else:
            scopes[-1][tag] += 1
        open_ = node
    if at < size and not open_.drop:
        open_.items.append(entities.unescape(page[at:]))
    return root


def _measure(root: Node) -> list[Node]:
    """Counts of every kept node (children before parents); returns the nodes in page order, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.drop]
    for node in reversed(order):
        chars = tags = link_chars = link_tags = 0
        for x in node.items:
            if isinstance(x, str):
                chars += len(x) - x.count(" ")
            elif not x.drop:
                chars += x.chars
                tags += x.tags + 1
                link_chars += x.link_chars
                link_tags += x.link_tags
        if node.tag == "a":
            link_chars, link_tags = chars, link_tags + 1
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in order:
        c, t = node.chars, max(node.tags, 1)
        if not c:
            node.density = 0.0
            continue
        base = math.log(c * node.link_chars / max(c - node.link_chars, 1) + share * c + math.e)
        node.density = max(0.0, c / t * math.log(max(c * t / (max(node.link_chars, 1) * max(node.link_tags, 1)), 1.0)) / math.log(base + 1.0))
    for node in order:
        node.total = sum(x.density * x.weight for x in node.items if isinstance(x, Node) and not x.drop)
    return order


def _judge(order: list[Node]) -> bool:
    """Drop or weigh down the elements with boilerplate names (parents first); whether there are any."""
    named = [n for n in order if n.named]
    if not named:
        return False
    root, inside = order[0], {id(n): [0, 0] for n in order}
    for node in reversed(order):  # articles, and paragraphs and the like, inside each element, itself included
        own = inside[id(node)]
        own[0] += node.tag in ("article", "main") and node.chars > 0
        own[1] += (node.tag in PROSE) and node.chars > 0
        if node.parent is not None:
            up = inside[id(node.parent)]
            up[0], up[1] = up[0] + own[0], up[1] + own[1]
    for node in order:  # and around it
        node.marks = (node.parent.marks if node.parent is not None else 0) + (node.tag in ("article", "main") and node.chars > 0)
    for node in named:
        most = 2 * (node.chars - node.link_chars) > root.chars - root.link_chars
        beside = inside[id(root)][0] > inside[id(node)][0] + node.marks  # an article that lies neither in it nor around it
        if node.named >= 3 and (beside or not most or node.named == 4 and not inside[id(node)][1]):
            node.drop = True
        elif not most:
            node.weight = NAMED
    for node in order[1:]:
        node.weight *= node.parent.weight
    return True


def _strip(order: list[Node], best: Node, top: Node) -> bool:
    """Drop containers with a boilerplate word in their names where they don't hold ``best``: of the class anywhere, else outside the article."""
    article = top if top.tag in ("article", "main") else best
    holds, within, found = {id(n) for n in _upwards(best)}, set(), False
    for node in order:
        if node is article or node.parent is not None and id(node.parent) in within:
            within.add(id(node))
        inside = id(node) in within
        if node.named and id(node) not in holds and node.tag in CONTAINERS and (node.named == 2 or node.named == 1 and not inside):
            node.drop = found = True
    return found


def _thin(x: Node, threshold: float, in_best: bool) -> bool:
    """A block whose density doesn't reach the threshold because of its links."""
    if x.tag in HEADINGS or x.density >= threshold or not x.link_tags:
        return False
    menu = x.link_tags > 1 and x.link_chars < SHORT_LINK * x.link_tags and x.link_chars * 2 > x.chars
    if in_best:
        return x.tag in CONTAINERS and (menu and x.link_tags >= MENU or x.tag not in ("ul", "ol", "dl", "table") and x.link_chars < x.chars <= 3 * x.link_chars)
    return menu or x.link_chars * 4 >= x.chars


def _blocks(node: Node, best: Node, threshold: float) -> list[str]:
    """The text blocks of a subtree in page order, without the thin ones."""
    out, line = [], []
    holds = {id(n) for n in _upwards(best)}

    def flush():
        text = _WHITE.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    stack = [(node, iter(node.items), node is best)]
    while stack:
        own, items, in_best = stack[-1]
        for x in items:
            if isinstance(x, str):
                line.append(x)
            elif x.drop:
                if x.tag in BLOCK:
                    flush()
            elif x.tag == "br":
                line.append(" ")
            else:
                if x.tag in BLOCK:
                    flush()
                    if id(x) not in holds and _thin(x, threshold, in_best):
                        continue
                stack.append((x, iter(x.items), in_best or x is best))
                break
        else:
            if own.tag in BLOCK:
                flush()
            stack.pop()
    flush()
    return out


def _upwards(node: Node):
    while node is not None:
        yield node
        node = node.parent


def _chosen(order: list[Node]) -> tuple[Node, Node]:
    """(the densest subtree, the element around it that holds the article)."""
    best = max(order, key=lambda n: n.total)  # of equal sums the first in page order
    if best.total <= 0:
        best = order[0]
    marked = next((n for n in _upwards(best) if n.tag in ("article", "main")), None)
    if marked is not None:
        return best, marked
    top = best
    # without such a mark: climb while the parent adds more text than links and is not much thinner
    while top.parent is not None and top.tag != "body":
        up = top.parent
        if up.link_chars - top.link_chars > (up.chars - top.chars) / 2 or up.density < best.density / 4:
            break
        top = up
    return best, top


def main_text(page: str) -> str:
    """The article of a page: blocks joined by an empty line."""
    root = parse(page)
    order = _measure(root)
    if _judge(order):
        order = _measure(root)
    if not root.chars:
        return ""
    best, top = _chosen(order)
    if any(n.named for n in order) and _strip(order, best, top):
        order = _measure(root)
        if not root.chars:
            return ""
        best, top = _chosen(order)
    threshold = min(n.density for n in _upwards(top) if n.chars or n is top)
    return "\n\n".join(_blocks(top, best, threshold))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    ship(pages.sparkSession)

    def run(batches):
        for b in slices(batches, "html"):
            texts = [main_text(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Main text of web pages by tree scoring.

The page is parsed into a tree; every paragraph passes points for its length and its commas to its ancestors, halved at
each step; a container's points are discounted by the share of its text that stands in links. The best container, and
the siblings that score near it or hold plain paragraphs, are kept; menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are cut off beforehand.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template".split())
DROPPED = frozenset("script style textarea title iframe noembed noframes noscript template head nav footer aside form button select option datalist dialog object applet svg math canvas audio video map menu".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul".split())
PARAGRAPH = frozenset("p pre blockquote td li dd div section".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset(("article", "main"))
KEPT_APART = frozenset(("html", "body", "article", "main"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
# Words in class and id attributes that mark page furniture, and those that say nothing beside one of them.
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner sidebar sidebars rail menu menus nav navbar navigation navi breadcrumb breadcrumbs pagination pager footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond responses discussion widget widgets skip copyright".split())
FURNITURE_PAIRS = frozenset(("site header", "page header", "top bar", "side bar", "nav bar", "bread crumbs", "read more", "skip link", "global header", "main header", "header bar"))
NEUTRAL = frozenset("site page main global top bottom left right inner outer box block bar area zone section wrap wrapper container holder group list item items row col column link links icon icons button buttons form text content title heading header head body post posts article articles story stories entry entries primary secondary sticky fixed small large big wide mobile desktop js is the and new".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())

TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "points", "length", "linked", "items")

    def __init__(self, tag: str, parent: Node | None, cut: bool):
        self.tag, self.parent, self.children, self.cut = tag, parent, [], cut
        self.points, self.length, self.linked, self.items = 0.0, 0, 0, 0


def tag_end(page: str, at: int, lone: set) -> int:
    """Where the tag that is open at `at` ends; quotes that never close are plain characters (remembered in `lone`)."""
    while m := QUOTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.start()
        close = -1 if m[0] in lone else page.find(m[0], m.end())
        if close < 0:
            lone.add(m[0])
            at = m.end()
        else:
            at = close + 1
    return len(page)


def furniture(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and any(map(marks_furniture, value.split())):
            return True
    return False


def marks_furniture(name: str) -> bool:
    """Whether a class or id names furniture as a whole: `notice-box` does, `notice-period` and `has-menu` don't."""
    words = [w.lower() for w in WORDS.findall(name)]
    if any(w in ("has", "with", "no") for w in words):
        return False
    pairs = [f"{a} {b}" in FURNITURE_PAIRS for a, b in zip(words, words[1:], strict=False)]
    marked = [w in FURNITURE or before or after for w, before, after in zip(words, [False, *pairs], [*pairs, False], strict=True)]
    return any(marked) and all(m or w in NEUTRAL or w.isdigit() for m, w in zip(marked, words, strict=True))


def parse(page: str, marks: bool = True) -> Node:
    """The page's tree. Children are nodes and strings; unclosed and stray tags are mended much as browsers do it."""
    root = here = Node("#root", None, False)
    at, lone, low = 0, set(), None
    opened: dict[str, int] = {}  # how many elements of a name are open

    def leave(node: Node) -> Node:
        opened[node.tag] -= 1
        return node.parent

    while m := TAG.search(page, at):
        if m.start() > at:
            here.children.append(page[at : m.start()])
        if m[1]:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            continue
        end = tag_end(page, m.end(), lone) if not m[2] else page.find(">", m.end())
        at = len(page) if end < 0 else end + 1
        if m[2]:
            continue
        name = m[4].lower()
        if m[3]:
            if opened.get(name):
                while here.tag != name:
                    here = leave(here)
                here = leave(here)
            elif name == "p" or name == "br":
                here.children.append(Node(name, here, False))
            continue
        if name in BLOCK and opened.get("p"):  # a block ends an open paragraph, unless a block stands between them
            up = here
            while up.tag != "p" and up.tag not in BLOCK and up.parent:
                up = up.parent
            if up.tag == "p":
                while here is not up:
                    here = leave(here)
                here = leave(here)
        if name in CLOSES:
            up, last = here, None
            while up.parent and up.tag not in SCOPE[name]:
                if up.tag in CLOSES[name]:
                    last = up
                up = up.parent
            if last:
                while here is not last:
                    here = leave(here)
                here = leave(here)
        attributes = page[m.end() : end]
        cut = name in DROPPED or marks and bool(attributes) and name not in KEPT_APART and furniture(attributes)
        node = Node(name, here, cut)
        here.children.append(node)
        if name in VOID or attributes.endswith("/") and name not in BLOCK and name not in RAW and name != "a":
            continue
        if name in RAW:
            low = low if low is not None else page.lower()
            if len(low) != len(page):  # lower case can be longer; then look at ASCII only
                low = re.sub(r"[A-Z]", lambda x: x[0].lower(), page)
            close = low.find(f"</{name}", at)
            if close < 0:
                at = len(page)
            else:
                at = tag_end(page, close, lone) + 1
            continue
        opened[name] = opened.get(name, 0) + 1
        here = node
    if at < len(page):
        here.children.append(page[at:])
    return root


def in_order(root: Node) -> list[Node]:
    """Every element, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def prune(root: Node) -> None:
    """Cuts what is furniture. A marked element that holds an article or the main element stays; so do headers inside one."""
    nodes = in_order(root)
    holds = set()
    for node in reversed(nodes):
        if (node.tag in WHOLE or id(node) in holds) and node.parent:
            holds.add(id(node.parent))
    inside = {id(root): False}
    for node in nodes[1:]:
        inside[id(node)] = inside.get(id(node.parent), False) or node.tag in WHOLE
        if node.tag == "header" and not inside[id(node)]:
            node.cut = True
        if node.cut and node.tag not in RAW and id(node) in holds:
            node.cut = False
    for node in nodes:
        if any(isinstance(c, Node) and c.cut for c in node.children):
            node.children = [c for c in node.children if not (isinstance(c, Node) and c.cut)]


def measure(root: Node) -> list[Node]:
    nodes = in_order(root)
    for node in reversed(nodes):
        own = "".join(c for c in node.children if isinstance(c, str))
        node.length = len(" ".join(own.split())) + sum(c.length for c in node.children if isinstance(c, Node))
        node.items = sum(c.items + (c.tag == "a") for c in node.children if isinstance(c, Node))
        node.linked = node.length if node.tag == "a" else sum(c.linked for c in node.children if isinstance(c, Node))
    return nodes


def blocks(roots: list[Node]) -> list[str]:
    """Texts of the blocks below the given elements, white space folded, empty ones left out."""
    out, now = [], []

    def close() -> None:
        text = " ".join(entities.unescape("".join(now)).split())
        if text:
            out.append(text)
        now.clear()

    stack: list = list(reversed(roots))
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif x.tag in BLOCK:
            close()
            stack.append(None)
            stack += reversed(x.children)
        else:
            stack += reversed(x.children)
    close()
    return out


def is_menu(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "table", "p") and node.items >= 3 and node.linked > 0.85 * node.length and node.length < 60 * node.items


def best(root: Node) -> list[Node]:
    """The elements whose text is kept."""
    nodes = measure(root)
    scored = []
    for node in nodes:
        if node.tag in PARAGRAPH or node.tag in HEADING:
            own = "".join(c if isinstance(c, str) else "" if c.tag in BLOCK else "".join(blocks([c])) for c in node.children) if node.tag != "p" else " ".join(blocks([node]))
            size = len(" ".join(own.split()))
            if size:
                points = (1.0 if size >= 25 else 0.2) + own.count(",") + min(size / 100, 3.0)
                up = node.parent if node.tag not in ("div", "section", "td") else node
                for _ in range(4):
                    if up is None or up.tag == "#root":
                        break
                    if not up.points:
                        scored.append(up)
                    up.points += points
                    points /= 2
                    up = up.parent
    if not scored:
        return [root]
    density = lambda n: n.linked / n.length if n.length else 0.0
    value = {id(n): n.points * (1 - density(n)) for n in scored}
    top = max(scored, key=lambda n: value[id(n)])
    up = top
    while up is not None and up.tag not in WHOLE:  # the article that the best container is a part of
        up = up.parent
    if up is not None:
        top = up
    if top.parent is None:
        return [top]
    least, kept = max(10.0, 0.2 * value.get(id(top), 0.0)), []
    for c in top.parent.children:
        if not isinstance(c, Node):
            continue
        if c is top or c.tag in HEADING or value.get(id(c), 0.0) >= least or c.tag == "p" and density(c) < 0.25 and c.length >= 80 and top.tag not in WHOLE:
            kept.append(c)
    return kept


def extract(page: str | None) -> str:
    """The main text: blocks in page order, one to a line; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    if not measure(root)[0].length:  # all of it was marked as furniture: go by the elements alone
        root = parse(page, marks=False)
        prune(root)
        measure(root)
    within = set()  # what stands in an article is its text, lists of links too
    for node in in_order(root):
        if node.tag in WHOLE or id(node.parent) in within:
            within.add(id(node))
        elif any(isinstance(c, Node) and is_menu(c) for c in node.children):
            node.children = [c for c in node.children if not (isinstance(c, Node) and is_menu(c))]
    return "\n".join(blocks(best(root)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(x) for x in b.column("html").to_pylist()]
        rest = [n for n in b.schema.names if n != "html"]
        yield pa.record_batch([*(b.column(n) for n in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars (its code points) in place of html.

    Map-only. A null or empty page has an empty text; a page of any length is read whole, in time linear in it; of
    containers with equal points the first counts; repeated pages are each answered; an empty table gives no rows; other
    columns pass through, and ones named text or n_chars are replaced.
    """
    pages = pages.select(*[f"`{c}`" for c in pages.columns if c not in ("text", "n_chars")])
    schema = pages.drop("html").schema.add("text", "string").add("n_chars", "long")
    return pages.mapInArrow(_extract, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    return extract_main_text(pages.select("page_id", "url", F.col("html")))

"""HTML extraction by tree scoring.

Each paragraph gives points (one, one a comma, up to three for length) to its ancestors: all to the parent, half to the
grandparent, less to those above. A container's points are cut by the share of its text that stands in links; article
and main elements start ahead. The best container is kept, with those of its siblings that score a fifth as much or are
long paragraphs with few links. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out wherever they stand, known by element or by a word of their class, id or role. A header inside an article and lists of
links in it belong to the article; an inline element is left out only if its whole class is such a word. Such a word may
also describe the whole page (``has-sidebar``), and a form may go around it: an element so marked is kept, its marked
parts aside, when it holds the main element or more than half of the page's unlinked text, and a form or a ``has-`` class
also when it holds the only articles. Hidden
elements never are, nor menus, controls, comments, dialogs and consent boxes unless they hold the main element.

White space inside a block becomes one space; blocks follow in page order, one a line. Null, empty and textless pages
give the empty text; of containers that score the same the first in page order is kept. Unclosed and truncated markup is read as browsers do: a block ends an open paragraph.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgauge.llm.common import text_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![^\s=/\"'])([^\s=/\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "template", "iframe", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "option", "object", "canvas"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|adbox|banner|breadcrumbs?|comments?|commentlist|disqus|respond|cookies?"
    r"|consent|gdpr|notice|alert|footer|footnav|header|masthead|menus?|nav|navbar|navigation|newsletter|subscribe|pagination|pager"
    r"|popup|modal|overlay|promo|promoted|related|recommended|share|sharing|social|sidebar|sidenav|sponsor|sponsored|toolbar|widget"
    r"|login|signup|search)(?=$|[\s_-])",
    re.I,
)
# these are whole in themselves, however much text they hold
SEPARATE = re.compile(
    r"(?:^|\s)(?:comments?|commentlist|disqus|respond|cookies?|consent|gdpr|popup|modal|overlay|newsletter)(?=$|[\s_-])", re.I
)
SEPARATE_TAGS = {"nav", "button", "select", "menu", "dialog", "option", "object", "canvas"}
SEPARATE_ROLES = {"navigation", "search", "dialog", "alert", "menu", "menubar"}
# class words that say what a page has, not what the element is
DESCRIBING = re.compile(r"(?:^|\s)(?:has|with|no|without)[_-]", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])")
NEVER_DROPPED = {"html", "body", "article", "main"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd"}
HEAD_STARTS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 5.0, "body": 0.0}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = {"ul", "ol", "dl", "table", "li", "tr", "div", "section", "body"}
SCOPES = {"ul", "ol", "dl", "table", "#root"}  # an item ends an open one only inside the same of these
ARTICLES = {"article", "main"}
SIBLING_SHARE = 0.2


class Node:
    """An element; ``block`` is the nearest block around it, ``scope`` the nearest list or table, itself included."""

    __slots__ = ("tag", "parent", "children", "dropped", "attributes", "score", "chars", "linked", "links", "block", "scope", "opened", "article")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, attributes: str = "") -> None:
        self.tag, self.parent, self.dropped, self.attributes = tag, parent, dropped, attributes
        self.children: list[Node | str] = []
        self.score, self.chars, self.linked, self.links = 0.0, 0, 0, 0
        self.block = parent if parent is None or parent.tag in BLOCKS or parent.tag == "#root" else parent.block
        self.scope = self if parent is None or tag in SCOPES else parent.scope
        self.opened: dict[str, int] | None = {} if self.scope is self else None  # open elements of the scope by tag
        self.article = tag in ARTICLES or parent is not None and parent.article


def _boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is none of the main text by its name, its class, id or role, or because it is hidden.

    A header inside an article is the article's own. An inline element's class must be such a word as a whole.
    """
    if tag in NEVER_DROPPED:
        return False
    own_header = in_article and tag in ("header", "div", "section", "hgroup")
    if tag in DROPPED and not (own_header and tag == "header"):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    inline = tag not in BLOCKS
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name in ("class", "id"):
            if inline:
                if any(found[0] == word for word in value.split() if (found := BOILERPLATE.search(word))):
                    return True
            else:
                words = {found.strip(" \t\r\n\f_-").lower() for found in BOILERPLATE.findall(value)}
                if words - ({"header", "masthead"} if own_header else set()):
                    return True
        if name == "role" and value.strip().lower() in DROPPED_ROLES and not (own_header and tag == "header"):
            return True
    return bool(HIDDEN.search(attributes))


def _separate(node: Node) -> bool:
    """Whether a dropped element is a menu, a control, a dialog, reader comments or a box over the page."""
    if node.tag in SEPARATE_TAGS:
        return True
    for name, *values in ATTRIBUTE.findall(node.attributes):
        value, name = "".join(values), name.lower()
        if name in ("class", "id") and SEPARATE.search(value):
            return True
        if name == "role" and value.strip().lower() in SEPARATE_ROLES:
            return True
    return False


def _describes(node: Node) -> bool:
    """Whether a dropped element is a form, or its class or id tells of other parts of the page."""
    return node.tag == "form" or any(
        name.lower() in ("class", "id") and DESCRIBING.search("".join(values)) for name, *values in ATTRIBUTE.findall(node.attributes)
    )


def _keep_wrappers(root: Node) -> None:
    """Keep the dropped elements that go around the page's main text."""
    order, stack, marked = [], [(root, False, False)], []
    while stack:
        node, inside, apart = stack.pop()
        if node.dropped:
            if HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", node.attributes)):
                continue
            inside, separate = True, _separate(node)
            apart = apart or separate
            marked.append((node, separate))
        order.append((node, inside, apart))
        stack += [(c, inside, apart) for c in node.children if isinstance(c, Node)]
    if not marked:
        return
    chars: dict[int, int] = {}
    mains: set[int] = set()
    articles: set[int] = set()
    outside = False
    for node, inside, apart in reversed(order):
        own = id(node)
        if node.tag == "main":
            mains.add(own)
        if node.tag == "article" and not apart:
            articles.add(own)
        outside |= node.tag in ("article", "main") and not inside
        # text of separate parts isn't counted, nor is linked text
        count = 0
        if not apart and node.tag != "a":
            count = chars.get(own, 0) + sum(len(c.strip()) for c in node.children if isinstance(c, str))
        chars[own] = count
        if node.parent is not None:
            above = id(node.parent)
            chars[above] = chars.get(above, 0) + count
            if own in mains:
                mains.add(above)
            if own in articles:
                articles.add(above)
    for node, separate in marked:
        own = id(node)
        if own in mains or not separate and (own in articles and not outside and _describes(node) or 2 * chars[own] > chars[id(root)]):
            node.dropped = False


def parse(page: str) -> Node:
    """The tree of a page; text stays as written, references undecoded.

    Open elements are counted by name, in all and in each list or table, so the way up is only taken where it ends at an
    open element, and every step of it closes one: the whole takes time linear in the page.
    """
    root = node = Node("#root", None, False)
    opened: dict[str, int] = {}
    at, size = 0, len(page)

    def up_to(node: Node, target: Node) -> Node:
        """Close everything from ``node`` to ``target``, which closes too."""
        while True:
            opened[node.tag] -= 1
            node.parent.scope.opened[node.tag] -= 1
            if node is target:
                return node.parent
            node = node.parent

    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            node.children.append(page[at:])
            break
        if found.start() > at:
            node.children.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if closing:
            if opened.get(tag) and tag not in ("html", "body"):
                above = node
                while above.tag != tag:
                    above = above.parent
                node = up_to(node, above)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else size
            continue
        if tag in VOID:
            node.children.append("\n" if tag in BLOCKS else " ")
            continue
        if tag in BLOCKS:
            # a block ends the paragraph that is open, whatever inline elements it left open
            if opened.get("p"):
                above = node if node.tag in BLOCKS else node.block
                while above.tag != "#root" and above.tag not in LISTS and above.tag not in ("p", "article", "main", "blockquote"):
                    above = above.block
                if above.tag == "p":
                    node = up_to(node, above)
            ends = CLOSES.get(tag)
            if ends and any(node.scope.opened.get(e) for e in ends):
                above = node
                while above.tag not in ends and above is not node.scope:
                    above = above.parent
                if above.tag in ends:
                    node = up_to(node, above)
        child = Node(tag, node, dropped := _boilerplate(tag, attributes, node.article), attributes if dropped else "")
        node.children.append(child)
        opened[tag] = opened.get(tag, 0) + 1
        of_scope = node.scope.opened
        of_scope[tag] = of_scope.get(tag, 0) + 1
        node = child
    return root


def _walk(root: Node) -> list[Node]:
    """Kept nodes, parents first."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    return found


def _measure(nodes: list[Node]) -> None:
    """Characters of text and of linked text below each node; children come after parents in ``nodes``."""
    for node in reversed(nodes):
        node.chars += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.linked = node.chars
            node.links += 1
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.links += node.links


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _own_text(node: Node) -> str:
    """Text of a paragraph up to blocks inside it."""
    parts, stack = [], list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif not item.dropped and item.tag not in BLOCKS:
            stack += reversed(item.children)
    return " ".join("".join(parts).split())


def _score(nodes: list[Node]) -> dict[int, Node]:
    """Candidates by identity; points of paragraphs in their ancestors, discounted by link density."""
    candidates: dict[int, Node] = {}
    for node in nodes:
        if node.tag not in PARAGRAPHS and not (
            node.tag in ("div", "section", "article", "main", "body", "#root") and _own_text(node)
        ):
            continue
        text = _own_text(node)
        if not text:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - _density(node))
        above, level = (node.parent if node.tag in PARAGRAPHS else node), 0
        if above is not None and above.tag not in BLOCKS and above.tag != "#root":
            above = above.block
        while above is not None and level < 5:
            if id(above) not in candidates:
                candidates[id(above)] = above
                above.score = HEAD_STARTS.get(above.tag, 0.0)
            above.score += points / (1, 2, 6, 9, 12)[level]
            level += 1
            above = above.block
    for node in candidates.values():
        node.score *= 1 - _density(node)
    return candidates


def _menu(node: Node) -> bool:
    """A list or box of links beside the text; inside an article it is part of the text."""
    return (
        not node.article
        and node.tag in ("ul", "ol", "div", "section", "table", "dl")
        and node.chars > 0
        and _density(node) > 0.6
        and node.links >= 3
    )


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks below a kept node, in page order."""
    blocks: list[list[str]] = [[]]
    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            blocks.append([])
        elif isinstance(item, str):
            if item == "\n":
                blocks.append([])
            blocks[-1].append(item)
        elif not item.dropped and not (item is not node and _menu(item)):
            block = item.tag in BLOCKS
            if block:
                blocks.append([])
                stack.append(None)
            stack += reversed(item.children)
    texts = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks)
    return [t for t in texts if t]


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    _keep_wrappers(root)
    nodes = _walk(root)
    _measure(nodes)
    candidates = _score(nodes)
    if not candidates:
        return ""
    best = max(candidates.values(), key=lambda n: n.score)  # of equals the first in page order
    if best.tag in ("#root", "html", "body") or best.parent is None:
        return "\n".join(_blocks(best))
    chosen = []
    for other in best.parent.children:
        if other is best:
            chosen.append(other)
        elif isinstance(other, Node) and not other.dropped and not _menu(other):
            text = _own_text(other) if other.tag == "p" else ""
            long_paragraph = len(text) > 80 and _density(other) < 0.25
            scored = id(other) in candidates and other.tag == best.tag and other.score >= max(10.0, SIBLING_SHARE * best.score)
            if long_paragraph or scored:
                chosen.append(other)
    return "\n".join(t for node in chosen for t in _blocks(node))


def extract_text(df: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """Add ``out``: the main text. Keeps all rows and columns; a column named ``out`` is replaced."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(extract)

    return df.withColumn(out, run(text_of(html)))

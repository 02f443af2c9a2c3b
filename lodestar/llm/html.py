"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their parent and, halved and
less, to higher ancestors; a container's points are discounted by the share of
its text that lies in links. The best container is kept whole. All text around
it, up to the root of the page, is kept too, less what is marked as no running
text or as beside the article and less blocks and lines that are mostly links;
no text goes for being short. All is read block by block in page order.

Defined cases: null or empty html, and pages without text, give an empty text;
markup that is never closed, closed twice or badly nested is read as far as it
goes; a page without any paragraph-like block is scored by its bare text;
containers that tie are taken in page order; pages of any length are read
whole; repeated rows are read each and other columns ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

# Elements whose content is no running text.
SKIPPED = {
    "script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "canvas", "math", "audio", "video",
    "form", "button", "select", "option", "textarea", "input", "nav", "footer", "aside", "menu", "dialog", "head", "title",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# An opening tag that ends an open element of these kinds (up to the next container).
_P_ENDS = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"} | {"form", "nav", "footer", "aside", "menu"}
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
    "option": {"option"},
}
_SCOPES = {"html", "body", "table", "ul", "ol", "dl", "article", "section", "div", "main", "td", "th", "blockquote", "form", "nav", "footer", "aside", "header", "button"}
_SCOPED = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

# Words in class, id and role that mark what is beside the article.
_BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|related|recommended|share|sharing|social|comments?|commentlist|disqus|replies|respond|"
    r"footer|masthead|toolbar|pagination|pager|login|signup|search|skip|complementary|contentinfo|tags?|copyright)(?:$|[\s_-])",
    re.I,
)
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|hentry)(?:$|[\s_-])", re.I)
_TAG_POINTS = {"article": 25, "main": 15, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "header": -10, "th": -5}
#: Text around the best container with this share in links goes.
MOSTLY = 0.5
_PARAGRAPHS = {"p", "pre", "td", "blockquote", "dd", "li", "div", "section", "article", "main", "body", "html", "center"}


class Node:
    __slots__ = ("tag", "parent", "parts", "points", "length", "linked", "skipped", "commas", "own")

    def __init__(self, tag: str, parent: Node | None, skipped: bool):
        self.tag, self.parent, self.skipped = tag, parent, skipped
        self.parts: list[Node | str] = []
        self.points = 0.0
        self.length = self.linked = self.commas = self.own = 0


class _Tree(HTMLParser):
    """Lenient tree builder: optional end tags are implied, stray ones ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.depth = {}  # open elements by tag

    def _close(self, node: Node) -> None:
        while self.at is not node:
            self.depth[self.at.tag] -= 1
            self.at = self.at.parent
        self.depth[node.tag] -= 1
        self.at = node.parent

    def _open_within(self, tags: set[str], border: set[str]) -> Node | None:
        if not any(self.depth.get(t) for t in tags):
            return None
        node, found = self.at, None
        while node.parent is not None and node.tag not in border:
            if node.tag in tags:
                found = node
            node = node.parent
        return found

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            # Attributes of the root are no hint; a second body is no element.
            return
        if tag in _ENDS:
            open_one = self._open_within(_ENDS[tag], _SCOPED[tag])
        else:
            open_one = self._open_within({"p"}, _SCOPES) if tag in _P_ENDS else None
        if open_one is not None:
            self._close(open_one)
        if self.depth.get("head") and tag in BLOCKS | {"nav", "footer", "aside", "form"}:
            self.handle_endtag("head")
        if tag in VOID:
            if tag in ("br", "hr") and not self.at.skipped:
                self.at.parts.append("\n" if tag == "hr" else " ")
            return
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        # What stands beside the article is told by each name alone: "comment-body" is a comment, and
        # "main-content with-sidebar" is an article by its first name.
        names = named.split()
        others = [name for name in names if not _BESIDE.search(name)]
        article = any(map(_ARTICLE.search, others))
        beside = len(others) < len(names) and tag not in ("article", "main") and not article
        hidden = any(
            k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v))
            for k, v in attrs
        )
        header = tag == "header" and not self.depth.get("article") and not self.depth.get("main")
        node = Node(tag, self.at, self.at.skipped or tag in SKIPPED or bool(beside) or hidden or header)
        if article and not node.skipped:
            node.points += 25
        node.points += _TAG_POINTS.get(tag, 0)
        self.at.parts.append(node)
        self.at = node
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("script", "style", "svg", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "p" and not self.depth.get("p"):
            return
        if self.depth.get(tag):
            node = self.at
            while node.tag != tag:
                # An inline end tag does not close blocks around it.
                if tag not in BLOCKS and tag not in SKIPPED and node.tag in BLOCKS:
                    return
                node = node.parent
            self._close(node)

    def handle_data(self, data):
        if not self.at.skipped:
            self.at.parts.append(data)


def _walk(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed([p for p in node.parts if type(p) is Node and not p.skipped]))
    return order


def _weigh(nodes: list[Node]) -> None:
    """Lengths, commas and linked lengths of all text below each node; ``own`` is text outside inner blocks."""
    for node in reversed(nodes):
        for part in node.parts:
            if type(part) is str:
                size = len(" ".join(part.split()))
                node.length += size
                node.own += size
                node.commas += part.count(",") + part.count("，") + part.count("、")
            elif not part.skipped:
                node.length += part.length
                node.linked += part.length if part.tag == "a" else part.linked
                if part.tag not in BLOCKS:
                    node.own += part.own
                    node.commas += part.commas


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _around(root: Node, best: Node) -> list[Node | str | None]:
    """What is kept of the page, in page order: the best container and what is not mostly links around it; None ends a line."""
    path = set()
    node = best.parent
    while node is not None:
        path.add(id(node))
        node = node.parent
    keep: list[Node | str | None] = []
    run: list[Node | str] = []

    def flush() -> None:
        sizes = [len(" ".join(p.split())) if type(p) is str else p.length for p in run]
        links = sum(0 if type(p) is str else p.length if p.tag == "a" else p.linked for p in run)
        if links < MOSTLY * sum(sizes):
            keep.extend(run)
        keep.append(None)
        run.clear()

    stack: list[Node | str | None] = [root]
    while stack:
        part = stack.pop()
        if part is None or part == "\n":
            flush()
        elif type(part) is str:
            run.append(part)
        elif part.skipped:
            continue
        elif id(part) not in path and part is not best and part.tag not in BLOCKS and part.own == part.length:
            run.append(part)
        else:
            flush()
            if id(part) in path or (part is not best and part.tag not in ("a", "h1") and _density(part) >= MOSTLY):
                stack.append(None)
                stack.extend(reversed(part.parts))
            elif part is best or part.tag != "a":
                keep.append(part)
    flush()
    return keep


def _blocks(keep: list[Node | str | None]) -> str:
    """Text of the parts, a line for each block."""
    lines: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            lines.append(text)
        run.clear()

    stack: list[Node | str | None] = list(reversed(keep))
    while stack:
        part = stack.pop()
        if part is None:
            flush()
        elif type(part) is str:
            if part == "\n":
                flush()
            else:
                run.append(part)
        elif not part.skipped:
            if part.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(part.parts))
    flush()
    return "\n".join(lines)


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes = _walk(tree.root)
    _weigh(nodes)
    if not tree.root.length:
        return ""
    scored: dict[int, Node] = {}
    for node in nodes:
        if node.tag not in _PARAGRAPHS or not node.own:
            continue
        points = (1 + node.commas + min(node.own / 100, 3)) * (1 - _density(node))
        # A paragraph that ends its own container counts for that container.
        above, share = (node.parent if node.tag in ("p", "pre", "td", "li", "dd", "blockquote") else node), 1.0
        level = 0
        while above is not None and level < 4:
            above.points += points * share
            scored[id(above)] = above
            level += 1
            share = 1 / (2 * level) if level < 2 else 1 / (3 * level)
            above = above.parent
    if not scored:
        return _blocks([tree.root])
    order = {id(n): k for k, n in enumerate(nodes)}
    final = {k: n.points * (1 - _density(n)) for k, n in scored.items()}
    best = max(scored.values(), key=lambda n: (final[id(n)], -order[id(n)]))
    if best.parent is None:
        return _blocks([best])
    return _blocks(_around(tree.root, best))


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for pages ``(page_id, url, html)``."""

    def start():
        def run(batch):
            texts = [extract(h) for h in batch["html"]]
            return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return run

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_rows(pages.select("page_id", "url", F.col("html")), f"page_id {kind}, url string, text string, n_chars long", start)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

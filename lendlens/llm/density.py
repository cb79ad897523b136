"""Main text of web pages by composite text density.

A page becomes a tree of elements. Menus, footers, scripts and the like, known by tag or role,
are taken out. Forms and names of adverts, comments and the like are only hints, as layouts use
the same words for wrappers: a hinted subtree is taken out if it and those of the same name hold
little of the text around them, if it is sparse, or if an article beside it is the main text. It
stays if it holds the page's only article or main element. For every other node the density is
its characters per tag, lowered by the share of link characters and link tags. A node's sum is the
sum of its children's densities. The node of the largest sum gives the threshold: the least
density on the path from the body to it. The article or main element around that node is the
main text; without one, subtrees from the body down that reach the threshold hold content, and
the smallest subtree around them is the main text. Blocks of links are left out, but not those
of an article or main element.

Defined results: NULL, empty and textless pages have an empty text. Tags that are never closed
end with their parent; markup that is cut off ends with the page. One row per page, equal pages
give equal texts.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|xmp)\b[^>]*>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Elements within a line of text; all others end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: An open element of these is ended by the tags beside it.
ENDED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]),
    "th": frozenset(["td", "th", "tr", "tbody"]),
    "option": frozenset(["option"]),
}
#: What an open element of ENDED_BY is not looked for beyond.
HELD_BY = frozenset("ul ol dl table select body article main section div".split())
BESIDE_TEXT = frozenset(
    "nav footer aside button select option dialog svg canvas object head menu".split()
)
BESIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert menu menubar "
    "advertisement".split()
)
BESIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices notification alert comment comments "
    "disqus respond reply replies sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead topbar share sharing social related recommended "
    "recommendations newsletter subscribe subscription popup modal overlay login signup search "
    "toolbar widget widgets pagination pager copyright skip".split()
)
#: Names like has-sidebar tell what is beside an element, not what it is.
BESIDE_IT = re.compile(r"(?:has|have|with|without|no|not|hide|show)[_-]")
#: A name is believed where its subtrees hold less than this share of the text around them.
SMALL = 1 / 3
#: An article outside hinted subtrees is the main text if it is this long beside one of them, by
#: whether that one holds an article or main element too.
BESIDE_ARTICLE = {False: 0.1, True: 0.5}
CONTENT = frozenset(["article", "main"])
BODY = "body"


class Node:
    __slots__ = (
        "tag", "parent", "parts", "beside", "hints", "chars", "links", "tags", "link_tags", "density"
    )

    def __init__(self, tag: str, parent: Node | None, beside: bool, hints: frozenset[str]):
        self.tag, self.parent, self.beside, self.hints = tag, parent, beside, hints
        self.parts: list[Node | str] = []

    def children(self) -> list[Node]:
        return [p for p in self.parts if not isinstance(p, str) and not p.beside]


NO_HINTS: frozenset[str] = frozenset()


def _is_beside(tag: str, rest: str, inside_content: bool) -> tuple[bool, frozenset[str]]:
    """Whether an element is beside the text for certain, and the names that hint at it."""
    if tag in BESIDE_TEXT or tag == "header" and not inside_content:
        return True, NO_HINTS
    hints = {tag} if tag == "form" else set()
    for name, value in ATTRIBUTE.findall(rest) if rest else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
            return True, NO_HINTS
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True, NO_HINTS
        if name == "role" and value in BESIDE_ROLES:
            return True, NO_HINTS
        if name == "role" and value == "form":
            hints.add(value)
        if name in ("class", "id") and tag not in (BODY, "html"):
            for word in value.split():
                if not BESIDE_IT.match(word):
                    hints |= BESIDE_NAMES.intersection(re.split(r"[_-]+", word))
            if value in ("header", "site-header", "page-header") and not inside_content:
                hints.add("header")
    return False, frozenset(hints) if hints else NO_HINTS


def tree(page: str) -> Node:
    """The page's elements and texts; forgiving of tags that are not closed."""
    root = node = Node(BODY, None, False, NO_HINTS)
    depth_of_content, at = 0, 0
    opened: Counter = Counter()  # open elements by tag, so that nobody climbs in vain

    def up_to(target: Node) -> None:
        nonlocal node, depth_of_content
        while node is not target:
            depth_of_content -= node.tag in CONTENT
            opened[node.tag] -= 1
            node = node.parent

    def open_one(tags: frozenset[str], held: frozenset[str]) -> Node | None:
        if not any(opened[tag] for tag in tags):
            return None
        seen = node
        while seen is not root:
            if seen.tag in tags:
                return seen
            if seen.tag in held:
                return None
            seen = seen.parent
        return None

    for token in TOKEN.finditer(page):
        if token.start() > at:
            node.parts.append(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if token["close"]:
            if tag not in ("html", BODY):
                found = open_one(frozenset([tag]), frozenset())
                if found is not None:
                    up_to(found.parent)
            continue
        if tag in ("html", BODY):
            continue
        if tag not in INLINE and tag not in VOID or tag == "hr":
            found = open_one(frozenset(["p"]), HELD_BY)
            if found is not None:
                up_to(found.parent)
        if tag in ENDED_BY:
            found = open_one(ENDED_BY[tag], HELD_BY)
            if found is not None:
                up_to(found.parent)
        made = Node(tag, node, *_is_beside(tag, token["rest"], depth_of_content > 0))
        node.parts.append(made)
        if tag not in VOID and not token["rest"].endswith("/"):
            node = made
            opened[tag] += 1
            depth_of_content += tag in CONTENT
    if at < len(page):
        node.parts.append(page[at:])
    return root


def _preorder(root: Node) -> list[Node]:
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(reversed(node.children()))
    return nodes


def measure(root: Node) -> list[Node]:
    """Sets characters, link characters, tags, link tags and density of every node."""
    nodes = _preorder(root)
    for node in reversed(nodes):
        text = sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str))
        children = node.children()
        node.chars = text + sum(c.chars for c in children)
        node.tags = len(children) + sum(c.tags for c in children)
        if node.tag == "a":
            node.links = node.chars
        else:
            node.links = sum(c.links for c in children)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in children)
    share = root.links / max(root.chars, 1)
    for node in nodes:
        node.density = _density(node, share)
    return nodes


def _density(node: Node, body_link_share: float) -> float:
    """Characters per tag, with a logarithm that falls as links take over."""
    chars, links = node.chars, max(node.links, 1)
    tags, link_tags = max(node.tags, 1), max(node.link_tags, 1)
    if not chars:
        return 0.0
    free = max(chars - node.links, 1)
    base = math.log(chars / free * links + body_link_share * chars + math.e)
    value = max(chars / links * tags / link_tags, 1.0)
    return chars / tags * math.log(value) / math.log(base) if base > 1 else chars / tags


def _sum(node: Node) -> float:
    return sum(child.density for child in node.children())


def _path(node: Node) -> list[Node]:
    """From the root to the node."""
    path = []
    while node is not None:
        path.append(node)
        node = node.parent
    return path[::-1]


def main_node(root: Node) -> tuple[Node, float]:
    """The subtree that holds the main text, and the density threshold."""
    nodes = measure(root)
    best = max(nodes, key=_sum)  # of equal sums the first in page order
    if not _sum(best):
        best = max(nodes, key=lambda node: node.density)
    threshold = min(node.density for node in _path(best))
    around = next((node for node in _path(best)[::-1] if node.tag in CONTENT), None)
    if around is not None:
        return around, threshold
    # Dense subtrees under each node of the path, down to the largest sum.
    found, stack = [best], [root]
    while stack:
        node = stack.pop()
        for child in node.children():
            if child.density >= threshold and not _link_block(child):
                found.append(max(_preorder(child), key=_sum) if child.children() else child)
            else:
                stack.append(child)
    common = _path(best)
    for node in found:
        own = _path(node)
        same = sum(1 for a, b in zip(common, own, strict=False) if a is b)
        common = common[:same]
    return common[-1], threshold


def _take_out_hinted(root: Node) -> None:
    """Marks the hinted subtrees that are beside the text."""
    nodes = _preorder(root)
    if not any(node.hints for node in nodes):
        return
    measure(root)
    outside = _outside(nodes)
    if not outside:
        # Of all elements the longest article is the last to be beside the text.
        found = [node for node in nodes if node.tag in CONTENT]
        for node in _path(max(found, key=lambda node: node.chars)) if found else ():
            node.hints = NO_HINTS
        outside = _outside(nodes)
    scope, over, holds = {}, {}, set()
    shares: dict[tuple[Node, str], int] = {}
    for node in nodes:
        # The article or main element around a node, and the names it is under there.
        up = node.parent
        scope[node] = root if up is None else up if up.tag in CONTENT else scope[up]
        over[node] = NO_HINTS if up is None or up.tag in CONTENT else over[up] | up.hints
        for name in node.hints - over[node]:
            shares[scope[node], name] = shares.get((scope[node], name), 0) + node.chars
    for node in reversed(nodes):
        if node.tag in CONTENT and node.chars:
            holds.add(node)
        if node in holds:
            holds.add(node.parent)
    unsure = []
    for node in nodes:
        if not node.hints:
            continue
        around, article = scope[node], node in holds
        node.beside = any(
            shares.get((around, name), around.chars) < SMALL * around.chars for name in node.hints
        )
        if around is root and outside:
            enough = outside >= BESIDE_ARTICLE[article] * node.chars
            node.beside = enough if article else enough or node.beside
        if not node.beside and not article:
            unsure.append(node)
    if unsure:
        _, threshold = main_node(root)
        for node in unsure:
            node.beside = node.density < threshold


def _outside(nodes: list[Node]) -> int:
    """Characters of the longest article or main element, without hinted subtrees."""
    free, under = dict.fromkeys(nodes, 0), set()
    for node in reversed(nodes):
        free[node] += sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str))
        if node.parent is not None and not node.hints:
            free[node.parent] += free[node]
    for node in nodes:
        if node.hints or node.parent in under:
            under.add(node)
    return max((free[n] for n in nodes if n.tag in CONTENT and n not in under), default=0)


def _link_block(node: Node) -> bool:
    """A block that is mostly links, of more than one link."""
    return node.tag not in INLINE and node.link_tags > 1 and 2 * node.links > node.chars


def text_of(root: Node) -> str:
    """The blocks' texts in page order, joined by one space."""
    pieces, stack = [], [iter([root])]
    whole = root.tag in CONTENT
    ends: list[bool] = [False]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            if ends.pop():
                pieces.append(" ")
        elif isinstance(part, str):
            pieces.append(html.unescape(part))
        elif not part.beside and (whole or part is root or not _link_block(part)):
            block = part.tag not in INLINE
            if block:
                pieces.append(" ")
            stack.append(iter(part.parts))
            ends.append(block)
        elif part.tag not in INLINE:
            pieces.append(" ")
    return " ".join("".join(pieces).split())


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    _take_out_hinted(root)
    return text_of(main_node(root)[0])


def _extract_all(pages: pd.Series) -> pd.Series:
    return pages.map(extract).astype(object)


def main_text(page: Column) -> Column:
    return F.pandas_udf(_extract_all, "string")(page)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return pages.select(
        "page_id", "url", main_text(F.coalesce("html", F.lit(""))).alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))

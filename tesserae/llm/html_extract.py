"""Main text of HTML pages by composite text density.

A page becomes a small tree. Elements that never hold article text (scripts, forms, menus, notices, adverts,
reader comments, ...) are cut out by tag, role, or class and id words. Every remaining node gets its link-adjusted
density of characters per tag; a node's score is the sum of its children's densities, and the node with the
highest score is the core of the text. The threshold is the lowest density on the path from the core to the body:
what stands beside that path and is at least as dense belongs to the text too, and so do headings that stand before
it. Bare text and inline elements in a row beside the path are one such part, with a density of their own. Parts too
short to be dense belong to the text inside a container of the core if they hold few links, and in the body if they lie
between parts that do. An ``article`` is evidence only: outside of one that holds the core, parts must be as dense as
the article. Pages whose ``article`` and ``main`` elements are renamed to ``div`` give the same texts on the test pages.

Blocks are joined by two line feeds; inside a block white space becomes one space.

Defined cases: a null or empty page has an empty text; unclosed, stray and missing tags are repaired as browsers
do for paragraphs, list items and table cells; repeated rows give repeated results; extra columns are ignored;
pages of any length and depth are read whole, without recursion; of nodes with equal scores the first in page order is
the core; a null id or url is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from tesserae.llm.common import map_batches, only

# Element names of the HTML standard by their role here, and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_TAGS = frozenset(
    "script style noscript template head title nav footer aside form button select option input textarea label "
    "fieldset iframe object embed applet svg canvas audio video map menu dialog datalist search noembed noframes".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
NOISE_WORDS = frozenset(
    "ad ads adbox adsense adslot adv advert adverts advertisement advertising banner breadcrumb breadcrumbs commentlist "
    "comment comments consent cookie cookiebar cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager paginate pagination paywall popup promo promoted promotion recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription teaser toolbar topbar widget widgets".split()
)
#: Words that begin a class or id of such a part ("sidebar2", "cookiewall").
NOISE_STEMS = ("advert", "breadcrumb", "cookie", "newsletter", "sidebar", "sponsor")
#: Words for reader comments, alone or with the name of a part ("commentsarea"); "commentary" is none.
COMMENT = re.compile(
    r"comment(?:s|ers?|ing)?(?:areas?|author|blocks?|body|box|containers?|content|count|entry|feed|form|holder|inner|items?"
    r"|links?|lists?|meta|outer|page|reply|respond|rows?|sections?|template|text|threads?|title|tree|wrap|wrapper)?"
)
#: Elements around a whole page on some sites: with an article, main or h1 inside, only their controls go.
WRAPPERS = frozenset("form fieldset".split())
#: Element -> open elements that it ends, and those that shield them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements through which an end tag of an inline element or of ``p`` does not reach.
SCOPES = frozenset("html body article section main table td th caption button object aside nav header footer".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: A tag with an unbalanced quote ends at the first bracket.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")


class Node:
    __slots__ = ("tag", "words", "roles", "hidden", "items", "parent", "noise", "chars", "tags", "links", "link_tags", "density", "score")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.items = tag, parent, []
        self.words, self.roles, self.hidden = frozenset(), frozenset(), False
        if attributes.strip(" \t\r\n\f/"):
            found = {}
            for m in ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
            names = f"{found.get('class', '')} {found.get('id', '')}"
            self.words = frozenset(w.lower() for w in WORD.findall(names))
            self.roles = frozenset(found.get("role", "").lower().split())
            style = found.get("style", "").replace(" ", "").lower()
            self.hidden = (
                "hidden" in found
                or found.get("aria-hidden", "").lower() == "true"
                or "display:none" in style
                or "visibility:hidden" in style
            )


def parse(page: str) -> Node:
    """The page's tree; items of a node are its child nodes and texts in order."""
    root = Node("html", None)
    body = Node("body", root)
    root.items.append(body)
    stack = [root, body]
    counts: Counter[str] = Counter()  # of the open elements
    at, n = 0, len(page)

    def text(part: str) -> None:
        if part:
            stack[-1].items.append(entities.unescape(part) if "&" in part else part)

    def close(names: set[str], shields: frozenset[str] | set[str]) -> None:
        if not any(counts[x] for x in names):
            return
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].tag in names:
                counts.subtract(x.tag for x in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in shields:
                return

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = TOKEN.match(page, lt) or LOOSE.match(page, lt)
        if not m:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].items.append(Node("br", stack[-1]))
            elif tag in ("html", "body"):
                pass
            elif tag in BLOCKS:
                close({tag}, SCOPES - {tag} if tag in ("p", "li") else frozenset())
            else:
                close({tag}, SCOPES)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPES)
        if tag in ENDS:
            names, shields = ENDS[tag]
            while any(counts[x] for x in names):
                depth = len(stack)
                close(names, shields)
                if len(stack) == depth:
                    break
        node = Node(tag, stack[-1], m[3] or "")
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.IGNORECASE).search(page, at)
            inner = page[at : end.start() if end else n]
            if tag in ("textarea", "title"):
                node.items.append(entities.unescape(inner))
            at = page.find(">", end.start()) + 1 or n if end else n
        elif tag not in VOID:
            stack.append(node)
            counts[tag] += 1
    return root


def in_order(root: Node) -> list[Node]:
    """Every node, parents before children."""
    nodes, todo = [], [root]
    while todo:
        x = todo.pop()
        nodes.append(x)
        todo.extend(c for c in reversed(x.items) if isinstance(c, Node))
    return nodes


def mark_noise(nodes: list[Node]) -> None:
    holds, frames = set(), set()  # nodes with an article, main or h1 inside; nodes with an article or main inside
    for x in reversed(nodes):
        if x.parent is not None and (x.tag in ("article", "main", "h1") or id(x) in holds):
            holds.add(id(x.parent))
        if x.parent is not None and (x.tag in ("article", "main") or id(x) in frames):
            frames.add(id(x.parent))
    article = set()
    for x in nodes:
        inside = x.parent is not None and id(x.parent) in article
        if inside or x.tag in ("article", "main"):
            article.add(id(x))
        x.noise = x.parent is not None and x.parent.noise
        if x.noise or x.tag in ("html", "body"):
            continue
        comment = any(w.startswith("comment") and COMMENT.fullmatch(w) for w in x.words)
        named = comment or bool(x.words & NOISE_WORDS) or any(w.startswith(NOISE_STEMS) for w in x.words)
        if x.tag == "article":
            x.noise = x.hidden or comment
        elif x.tag == "header":
            x.noise = not inside and id(x) not in frames or x.hidden
        elif x.tag in ("main", "h1"):
            x.noise = x.hidden
        else:
            wraps = id(x) in holds and x.tag in WRAPPERS
            roles = x.roles - {"form"} if wraps else x.roles
            x.noise = (x.tag in NOISE_TAGS and not wraps) or x.hidden or bool(roles & NOISE_ROLES) or (named and id(x) not in holds)
        if not x.noise and x.parent is not None and x.parent.tag == "header" and id(x) not in holds:
            x.noise = x.tag not in HEADINGS and x.tag != "hgroup"


def set_density(x: Node, ratio: float) -> None:
    """Link-adjusted characters per tag; ``ratio``: link characters of all characters on the page."""
    c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.links), max(1, x.link_tags)
    base = math.log(c / max(1, c - x.links) * x.links + ratio * c + math.e)
    x.density = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1 + 1e-9)) if base > 1 else math.log(max(1.0, c / lc * t / lt)))


def measure(nodes: list[Node]) -> float:
    """Characters, tags, link characters and densities, leaves first; returns the page's share of link characters."""
    for x in nodes:
        x.chars = x.tags = x.links = x.link_tags = 0
        x.density = x.score = 0.0
    for x in reversed(nodes):
        if x.noise:
            continue
        x.chars += sum(len("".join(t.split())) for t in x.items if isinstance(t, str))
        if x.tag == "a":
            x.links, x.link_tags = x.chars, x.link_tags + 1
        if x.parent is not None:
            p = x.parent
            p.chars += x.chars
            p.tags += x.tags + 1
            p.links += x.links
            p.link_tags += x.link_tags
    body = nodes[0]
    ratio = body.links / max(1, body.chars)
    for x in nodes:
        if x.noise or not x.chars:
            continue
        set_density(x, ratio)
        if x.parent is not None:
            x.parent.score += x.density
    return ratio


def gather_runs(parent: Node, child: Node, mixed: set[int], ratio: float) -> None:
    """Bare texts and inline elements in a row become one nameless node; ``child`` and what is in ``mixed`` stay alone."""
    items: list = []
    run: Node | None = None
    for x in parent.items:
        if isinstance(x, Node) and (x is child or x.tag in BLOCKS or id(x) in mixed):
            run = None
            items.append(x)
            continue
        if run is None:
            run = Node("", parent)
            run.noise, run.chars, run.tags, run.links, run.link_tags = False, 0, 0, 0, 0
            items.append(run)
        run.items.append(x)
        if isinstance(x, str):
            run.chars += len("".join(x.split()))
        elif not x.noise:
            run.chars += x.chars
            run.tags += x.tags + 1
            run.links += x.links
            run.link_tags += x.link_tags
    for x in items:
        if x.tag == "":
            set_density(x, ratio)
    parent.items = items


def blocks_of(root: Node, chosen: set[int] | None) -> list[str]:
    """Texts of blocks in page order; with ``chosen``, of the subtrees of those nodes alone."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if made := " ".join("".join(held).split()):
            out.append(made)
        held.clear()

    todo: list = [(root, chosen is None)]
    while todo:
        item, on = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if on:
                held.append(item)
        elif not item.noise:
            if item.tag in ("br", "wbr"):
                held.append(" " if item.tag == "br" and on else "")
                continue
            on = on or id(item) in chosen
            block = item.tag in BLOCKS
            if block:
                flush()
                todo.append((None, on))
            todo.extend((c, on) for c in reversed(item.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = in_order(root)
    mark_noise(nodes)
    ratio = measure(nodes)
    body = root.items[0]
    inner = [x for x in nodes[1:] if not x.noise and x.chars]
    if not inner:
        return ""
    core = max(inner, key=lambda x: x.score)
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    if core is body or not core.score:
        return "\n\n".join(blocks_of(body, {id(body)}))
    chosen = {id(core)}
    mixed = set()  # nodes that hold a block
    for x in reversed(nodes):
        if x.parent is not None and (x.tag in BLOCKS or id(x) in mixed):
            mixed.add(id(x.parent))
    outside = False  # of an article that holds the core
    for child, parent in zip(path, path[1:], strict=False):
        gather_runs(parent, child, mixed, ratio)
        if child.tag == "article":
            outside, threshold = True, max(threshold, child.density)
        chosen.update(id(x) for x in beside(parent, child, threshold, outside or parent is body))
    return "\n\n".join(blocks_of(body, chosen))


def beside(parent: Node, child: Node, threshold: float, apart: bool) -> list[Node]:
    """The parts of ``parent`` beside ``child``, a node of the core's path, that belong to the text.

    Dense parts do, and headings before the path. In a container around the core short parts with few links do too: a
    paragraph of one word is not dense. Where other parts of the page stand (``apart``: in the body, and outside of an
    article) such parts belong to the text only between two that do.
    """
    parts = [x for x in parent.items if isinstance(x, Node) and (x is child or (not x.noise and x.chars))]
    at = next(i for i, x in enumerate(parts) if x is child)
    own = [x is child or x.density >= threshold or (i < at and x.tag in HEADINGS) for i, x in enumerate(parts)]
    if apart:
        first, last = own.index(True), len(own) - 1 - own[::-1].index(True)
        own = [o or (first < i < last and not x.link_tags) for i, (o, x) in enumerate(zip(own, parts, strict=True))]
    else:
        own = [o or 2 * x.links < x.chars for o, x in zip(own, parts, strict=True)]
    return [x for o, x in zip(own, parts, strict=True) if o and x is not child]


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b[html]]
            yield {page_id: b[page_id], url: b[url], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(only(pages, page_id, url, html), run, f"`{page_id}` {kind}, `{url}` string, text string, n_chars bigint")

"""Main text of web pages by scoring the element tree.

Paragraphs give points for their length and commas to their ancestors; a container's points are
discounted by the share of its text inside links. The container with most points is kept with
the siblings that score well beside it. What is boilerplate by its element, role or name is
taken out first: menus, headers, footers, sidebars, notices, adverts, forms, comments.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import slices

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:[\"'][^>]*+)?>?", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Elements and attribute words of HTML and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title template svg object canvas video audio".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("nav footer aside form button select input menu dialog head fieldset".split())
FORMS = frozenset("form fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices notification alert newsletter subscribe subscription signup popup modal overlay menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar widget widgets related recommended recommendations share sharing social footer header masthead topbar toolbar "
    "pagination pager login search skip disclaimer copyright paywall".split())
#: Of these, names that a text's own container may bear: not boilerplate if most of the page's prose is in it.
WEAK_NAMES = frozenset("notice notices alert share sharing social promo promotion sponsor sponsored subscription notification copyright disclaimer login search skip".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies respond responses respondents reactions discussion".split())
GOOD_NAMES = frozenset("article content main post entry story body text page".split())
WITH_NAMES = frozenset("with has no without".split())
#: Start tags that end an open element of the first kind, and the elements beyond which they do not look.
IMPLIED = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}),
           "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
ENDS_PARAGRAPH = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
SCOPE = frozenset("table td th body html article section div".split())
PROSE = frozenset("p pre blockquote td th li dd dt h1 h2 h3 h4 h5 h6".split())
LEAST_CHARS = 25


class Node:
    __slots__ = ("tag", "parent", "children", "attributes", "chars", "linked", "points", "prose")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list = []
        self.chars = self.linked = self.prose = 0
        self.points = 0.0


def parse(page: str) -> Node:
    """The element tree; unclosed, stray and wrongly nested tags are tolerated."""
    root = here = Node("#root", None)
    open_tags: Counter = Counter()
    at = 0

    def close(node: Node) -> Node:
        nonlocal here
        while here is not node:
            open_tags[here.tag] -= 1
            here = here.parent
        open_tags[node.tag] -= 1
        here = node.parent
        return node

    def nearest(tags, limits) -> Node | None:
        if not any(open_tags[t] for t in tags):
            return None
        node = here
        while node is not root:
            if node.tag in tags:
                return node
            if node.tag in limits:
                return None
            node = node.parent
        return None

    while at < len(page):
        found = MARKUP.search(page, at)
        if found is None:
            here.children.append(page[at:])
            break
        if found.start() > at:
            here.children.append(page[at : found.start()])
        at = found.end()
        if found["tag"] is None:
            if found.group().startswith("<![CDATA["):
                here.children.append(found.group()[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = found["tag"].lower()
        if found["end"]:
            if open_tags[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                close(node)
            elif tag == "br" or tag == "p":
                here.children.append("\n")
            continue
        if tag in ENDS_PARAGRAPH and (old := nearest(("p",), SCOPE)):
            close(old)
        if tag in IMPLIED and (old := nearest(IMPLIED[tag][0].split(), IMPLIED[tag][1])):
            close(old)
        if tag in HEADINGS and here.tag in HEADINGS:
            close(here)
        node = Node(tag, here, found["attributes"])
        here.children.append(node)
        if tag in RAW:
            if not found["attributes"].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag not in VOID and not (found["attributes"].rstrip().endswith("/") and tag not in BLOCKS):
            here = node
            open_tags[tag] += 1
    return root


def _names(values: dict[str, str]) -> set[str]:
    """Words of the class and id names; one that says whether the page has something (``has-sidebar``) names nothing."""
    found = set()
    for name in (values.get("class", "") + " " + values.get("id", "")).split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        found.update(p for before, p in zip([""] + parts, parts) if before not in WITH_NAMES)
    return found


def _is_boilerplate(node: Node, prose: int) -> bool:
    """``prose``: characters of the page's paragraphs; what holds more than half of them is judged more gently."""
    tag, main = node.tag, 2 * node.prose > prose
    if tag in RAW or (tag in NEVER and not (tag in FORMS and main)):
        return True
    if not node.attributes:
        return tag == "header" and not _within_article(node)
    values = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attributes)}
    if values.get("role", "").lower() in BAD_ROLES and not (tag in FORMS and main):
        return True
    if tag in ("html", "body"):
        return False
    names = _names(values)
    if names & COMMENT_NAMES or (tag == "header" and not _within_article(node)):
        return True
    bad = names & BAD_NAMES - (WEAK_NAMES if main else frozenset())
    return bool(bad) and tag not in ("article", "main") and not names & GOOD_NAMES


def _within_article(node: Node) -> bool:
    while node.parent is not None:
        node = node.parent
        if node.tag in ("article", "main"):
            return True
    return False


def _count_prose(root: Node) -> None:
    """Sets the characters of paragraphs, quotes, cells, items and headings below each element."""
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str)) if node.tag not in RAW else 0
        node.prose += own  # below a paragraph all text counts, elsewhere only what paragraphs gave
        if node.parent is not None and (node.tag in PROSE or node.tag not in BLOCKS):
            node.parent.prose += node.prose
        elif node.parent is not None:
            node.parent.prose += node.prose - own


def _prune_and_order(root: Node) -> list[Node]:
    """Takes boilerplate out of the tree; the remaining elements, parents first."""
    _count_prose(root)
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not _is_boilerplate(c, root.prose)]
        waiting += [c for c in reversed(node.children) if not isinstance(c, str)]
    return order


def _score(order: list[Node]) -> None:
    """Sets text lengths, link lengths and points of all elements."""
    for node in reversed(order):
        own = [c for c in node.children if isinstance(c, str)]
        text = " ".join(" ".join(own).split())
        node.chars += len(text)
        if node.tag == "a":
            node.linked = node.chars
        inline = text + " ".join(" ".join(g for g in c.children if isinstance(g, str)) for c in node.children if not isinstance(c, str) and c.tag not in BLOCKS)
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
        if (node.tag in BLOCKS or node.tag == "#root") and node.chars >= LEAST_CHARS and text:
            points = 1 + inline.count(",") + inline.count("،") + inline.count("、") + inline.count("，") + min(node.chars // 100, 3)
            weight, up = 1.0, node.parent if node.tag in ("p", "pre", "blockquote", "td", "li", "dd") or node.tag in HEADINGS else node
            for _ in range(3):
                while up is not None and up.tag not in BLOCKS and up.tag != "#root":
                    up = up.parent
                if up is None:
                    break
                up.points += points * weight
                weight, up = weight / 2, up.parent
    for node in order:
        node.points *= 1 - node.linked / node.chars if node.chars else 0


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _kept(root: Node, order: list[Node]) -> list:
    """The best container and what goes with it, elements and bare text, in page order.

    In an ``article`` or ``main`` element that is the element, and siblings that score well beside
    it. Elsewhere nothing says where the article ends, so from the best container up to the page's
    body everything beside it is kept but what consists mostly of links.
    """
    best = max(order, key=lambda n: n.points)  # the first of equals
    if not best.points:
        named = [n for n in order if n.tag in ("article", "main")] or [n for n in order if n.tag == "body"] or [root]
        return named if sum(n.linked for n in named) * 2 <= sum(n.chars for n in named) else []
    node = best
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    if node is not None and node.parent is not None:
        least, kept = 0.2 * node.points, []
        for sibling in node.parent.children:
            if isinstance(sibling, str):
                continue
            short_text = sibling.tag in ("p", "pre", "blockquote") and _density(sibling) < 0.25 and (
                sibling.chars > 80 or (sibling.chars and not sibling.linked))
            title = sibling.tag in HEADINGS and _density(sibling) < 0.5
            if sibling is node or (sibling.points and sibling.points >= least) or short_text or title:
                kept.append(sibling)
        return kept
    whole = best
    while whole.parent is not None and whole.tag != "body":
        above = whole.parent
        above.children = [c for c in above.children if isinstance(c, str) or c is whole or _density(c) < 0.5]
        whole = above
    return [whole]


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks below an element, white space turned into single spaces."""
    done, current = [], []

    def flush():
        text = " ".join("".join(current).split())
        if text:
            done.append(text)
        current.clear()

    waiting: list = [node]
    while waiting:
        item = waiting.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            current.append(entities.unescape(item))
        elif item.tag == "br" or item.tag == "wbr":
            current.append(" " if item.tag == "br" else "")
        else:
            block = item.tag in BLOCKS
            if block:
                flush()
                waiting.append(None)
            waiting += reversed(item.children)
    flush()
    return done


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null, empty or text-free pages."""
    if not page:
        return ""
    root = parse(page)
    order = _prune_and_order(root)
    _score(order)
    return "\n".join(text for node in _kept(root, order) for text in _blocks(node))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole source.

    Null and empty pages, and pages without text outside boilerplate, have an empty text.
    Markup that is broken is read as browsers would; nothing fails. Repeated rows give repeated
    results; other columns are not read.
    """
    frame = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    schema = T.StructType([*frame.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch, sources in slices(batches, "html"):
            texts = list(map(main_text, sources))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return frame.mapInArrow(run, schema)

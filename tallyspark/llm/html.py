"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text inside one block-level element, with the path of
block-level tags from the root. For each path the length of its text and the number of its
punctuation marks are taken per block; both ratios are smoothed over the page's paths with
weights that fall by FALL with each step between two paths in the tree; fused, they are compared
with a part of the page's text-weighted mean, and paths at or above it are content. Short paths
are fused once more at the nearest ancestor that holds content: lists, tables, headings and
the like below an element that holds content belong to it, unless most of what hangs there
beside the content is links, as in a menu. Directly below the body only what stands between two
pieces of content does, and only if it is a list, table, heading or the like. Paths through
elements that never hold an article's text (navigation, forms, adverts, comments, ... by tag,
role, class or id) are left out before.

Sums run up and down the tree once, so a page takes time in proportion to its length.

Only a page's own statistics are used, so pages are worked on one by one, wherever they lie.

Defined results: a null or empty page, and one without content, has the text ``""``; markup
that is not closed or not opened is closed where its parent ends, or ignored; repeated rows
give repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import per_value

#: What is left of a path's weight a step further in the tree.
FALL = 0.5
#: Paths from this part of the mean on are content.
THRESHOLD = 0.15
#: Weight of punctuation beside length when the two ratios are fused.
PUNCTUATION = 0.25
#: From this part of its text inside links on, a group of short blocks is a menu.
LINKED = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>"
    r"|<[!?/a-zA-Z][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PUNCTUATION = re.compile(r"[.,;:!?…、。]")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

# Elements of HTML that start a block, and those without an end.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav"
    " ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements, roles and names that mark what is no article.
NEVER = frozenset("aside button dialog footer form head header menu nav option select".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies copyright disqus footer header login masthead menu modal nav navbar navigation newsletter"
    " notice notices pager pagination popup promo related replies reply respond share sharing sidebar"
    " signup social sponsor sponsored subscribe toolbar widget".split()
)
# What may stand beside such a name in a compound one, as in site-footer.
BESIDE = frozenset(
    "area article author bar body bottom box button buttons center cell col column container content"
    " count desktop entry fixed global group holder icon icons id inline inner item items js left link"
    " links list lower main meta mobile my outer page panel place post primary reader region right row"
    " secondary section site slot small sticky story tab text the thread title top unit upper user wrap"
    " wrapper zone".split()
)
# Elements that are part of an article even between its paragraphs.
WITHIN = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre section table ul".split())
IN_BODY = frozenset(["", "html", "body"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An open element of the key ends where one of the value starts.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}


def _marked(name: str) -> bool:
    """Whether a class or id as a whole, and not just some part of it, is one of no article."""
    parts = [part.lower() for part in _PART.findall(name)]
    return any(part in NAMES for part in parts) and all(
        part in NAMES or part in BESIDE or part.isdigit() for part in parts
    )


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's name in a path, and whether it is no article by its names."""
    found = {}
    for match in _ATTRIBUTE.finditer(attributes):
        found[match[1].lower()] = match[2] or match[3] or match[4] or ""
    never = tag in NEVER or found.get("role", "").lower() in ROLES
    if tag not in ("html", "body", "main"):
        never = never or any(map(_marked, f"{found.get('class', '')} {found.get('id', '')}".split()))
    name = found.get("class", "").lower()
    return f"{tag}.{name}" if name else tag, never


class Page:
    """The blocks of a page, its elements as a tree, and their paths as a tree: elements of one
    path share a node. Number 0 is the root of both, parents come first."""

    def __init__(self) -> None:
        self.parent = [0]  # of nodes
        self.children: dict[tuple[int, str], int] = {}
        self.inside, self.node, self.tag = [0], [0], [""]  # of elements
        #: (element, text, characters inside links) in page order
        self.blocks: list[tuple[int, str, int]] = []

    def open(self, inside: int, tag: str, name: str) -> int:
        """A new element inside another one."""
        above = self.node[inside]
        node = self.children.setdefault((above, name), len(self.parent))
        if node == len(self.parent):
            self.parent.append(above)
        self.inside.append(inside)
        self.node.append(node)
        self.tag.append(tag)
        return len(self.tag) - 1


def read_page(source: str) -> Page:
    """The blocks of text that may be content, with their paths."""
    page = Page()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, never
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link, last = 0, False, 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not stack[-1][2]:
                page.blocks.append((stack[-1][1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            parts.append(text)
            linked += len(text) if in_link else 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for token in _TOKEN.finditer(source):
        add(source[last : token.start()])
        last = token.end()
        tag = (token[3] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = not token[2]
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            end_block()
            if token[2]:
                while opened[tag]:
                    if pop() == tag:
                        break
                in_link = False
                continue
            if stack[-1][0] == "p":
                pop()
            while tag in ENDS.get(stack[-1][0], ()):
                pop()
            if tag not in VOID:
                name, never = _named(tag, token[4] or "")
                above = stack[-1]
                stack.append((tag, page.open(above[1], tag, name), never or above[2]))
                opened[tag] += 1
    add(source[last:])
    end_block()
    return page


def smoothed(page: Page, values: list[float], held: list[bool]) -> list[float]:
    """The mean of the values of nodes that hold text, weighted by FALL to the distance."""
    size = len(page.parent)
    sums = [value if has else 0.0 for value, has in zip(values, held, strict=True)]
    weights = [float(has) for has in held]
    for node in range(size - 1, 0, -1):
        above = page.parent[node]
        sums[above] += FALL * sums[node]
        weights[above] += FALL * weights[node]
    # what comes from below is in the sums; the rest comes by the parent
    for node in range(1, size):
        above = page.parent[node]
        sums[node] += FALL * (sums[above] - FALL * sums[node])
        weights[node] += FALL * (weights[above] - FALL * weights[node])
    return [total / weight if weight else 0.0 for total, weight in zip(sums, weights, strict=True)]


def dense_nodes(page: Page) -> list[bool]:
    """Whether the smoothed and fused ratios of a node's own text reach the threshold."""
    size = len(page.parent)
    count, length, marks, linked = ([0] * size for _ in range(4))
    for element, text, inside in page.blocks:
        node = page.node[element]
        count[node] += 1
        length[node] += len(text)
        marks[node] += len(_PUNCTUATION.findall(text))
        linked[node] += inside
    held = [n > 0 for n in count]
    lengths = smoothed(page, [v / max(1, n) for v, n in zip(length, count, strict=True)], held)
    points = smoothed(page, [v / max(1, n) for v, n in zip(marks, count, strict=True)], held)
    fused = [
        lengths[n] * (1 + PUNCTUATION * points[n]) * (1 - linked[n] / length[n]) if held[n] else 0.0
        for n in range(size)
    ]
    weight = sum(length)
    mean = sum(f * v for f, v in zip(fused, length, strict=True)) / weight if weight else 0.0
    return [value > 0 and value >= THRESHOLD * mean for value in fused]


def content(page: Page) -> list[bool]:
    """Whether each block is content."""
    dense = dense_nodes(page)
    size = len(page.tag)
    holds, length, linked = [False] * size, [0] * size, [0] * size
    for element, text, inside in page.blocks:
        holds[element] = dense[page.node[element]]
        length[element] += len(text)
        linked[element] += inside
    for element in range(size - 1, 0, -1):
        above = page.inside[element]
        holds[above] = holds[above] or holds[element]
        length[above] += length[element]
        linked[above] += linked[element]
    # the largest element without content that an element lies in; its parent holds content
    group = [0] * size
    for element in range(1, size):
        above = page.inside[element]
        if not holds[element]:
            group[element] = element if holds[above] else group[above]
    kept = [dense[page.node[element]] for element, _, _ in page.blocks]
    if not any(kept):
        return kept
    first, final = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
    # a heading right before the first content belongs to it
    while first and page.tag[page.blocks[first - 1][0]] in HEADINGS:
        first -= 1

    def belongs(number: int, element: int) -> bool:
        tag, outer = page.tag[element], element
        if not holds[element]:
            outer = page.inside[group[element]]
            tag = page.tag[group[element]]
            if linked[group[element]] >= LINKED * length[group[element]] and tag not in HEADINGS:
                return False
        if page.tag[outer] in IN_BODY:
            return first <= number < final and (tag in WITHIN or holds[element])
        return True

    return [keep or belongs(i, element) for i, (keep, (element, _, _)) in enumerate(zip(kept, page.blocks, strict=True))]


def main_text(source: str | None) -> str:
    """The text of the content blocks in page order, joined by one space."""
    page = read_page(source or "")
    return " ".join(text for (_, text, _), keep in zip(page.blocks, content(page), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return pages.select("page_id", "url", per_value(main_text, "string")("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )

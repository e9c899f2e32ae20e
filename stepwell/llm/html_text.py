"""Main text of web pages by composite text density.

Every page becomes a tree. Each node gets its characters per tag, adjusted for links: text
that is mostly links counts little. The sum of the densities of a node's children is
largest at the node that directly holds the article's paragraphs. An enclosing article or main element
is the result. Elsewhere each step of the path to the body has a threshold, half of the largest density on the path so
far: what stands beside the path is taken along where it reaches the threshold, and so are headings before it; a menu, a
list of headlines or a line of copyright is not. Elements that are never article text by their tag or
role are cut out before, and those named as menus, adverts, comments and so on by class or id,
unless they wrap the article: a name may also say what a wrapper has beside the text.

Pages are independent: one scan, no shuffle, one page in memory at a time.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stepwell.llm.common import column

TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*)"
    r"|[!?][^>]*(?:>|$)"
    r"|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$))",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "html body p div section article main h1 h2 h3 h4 h5 h6 ul ol li table thead tbody tfoot caption tr td th "
    "blockquote pre figure figcaption dl dt dd address hr header footer aside nav form fieldset details summary center".split()
)
#: Elements that a start tag of the key closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
NOISE_TAGS = frozenset(
    "head script style noscript template textarea title xmp iframe noembed noframes nav footer aside form button "
    "select option input svg canvas object audio video dialog menu label fieldset".split()
)
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert form menu menubar".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored sidebar aside menu "
    "nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments replies reply respond disqus widget pagination pager toolbar search form".split()
)
#: Names that articles have too: cut only where the text is thinner than that of the page.
AMBIGUOUS = frozenset("share sharing social related recommended notice notices alert search form menu reply respond sponsor subscription".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What stands beside the article has this share of its density, or more.
BESIDE = 0.5
KEPT = frozenset("html body article main".split())
#: An element that holds more of the page's unlinked text than this wraps the page.
WRAPS = 0.5
#: How an element is noise: not, by its tag, role or state, by its name, by a name that articles have too.
CLEAN, SURE, NAMED, MAYBE = range(4)


def _noise(tag: str, attributes: str, inside: bool) -> int:
    """How the element is noise. ``inside``: within an article or main element, where a header is a heading."""
    if tag in NOISE_TAGS or (tag == "header" and not inside):
        return SURE
    if not attributes or tag in KEPT:
        return CLEAN
    kind, parts = CLEAN, set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            parts |= {p.lower() for p in NAME_PART.findall(value)}
        elif (
            name == "hidden"
            or (name == "role" and value.lower() in NOISE_ROLES)
            or (name == "style" and "display:none" in value.replace(" ", "").lower())
        ):
            kind = SURE
    if kind == CLEAN and (parts & NOISE_NAMES or ("header" in parts and not inside)):
        kind = NAMED if parts & (NOISE_NAMES - AMBIGUOUS) or "header" in parts else MAYBE
    return kind


class Page:
    """Tree in page order: of each node its tag, parent and how it is noise; and the texts with their node."""

    def __init__(self, source: str):
        self.tags, self.parents, self.noise = ["#root"], [0], [CLEAN]
        self.texts: list[tuple[int, str]] = []
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) at a block's border
        # depths in the stack: of the open elements of a tag, of blocks, of blocks that hold implied ends in
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]
        self.containers: list[int] = [0]
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, inside, end = [0], 0, 0, len(source)
        while at < end:
            found = TAG.search(source, at)
            if not found:
                break
            if found.start() > at:
                self._text(stack[-1], source[at : found.start()])
            at = found.end()
            closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                inside -= self._close(stack, tag)
                continue
            for old in CLOSES.get(tag, ()) if tag not in BLOCK else {*CLOSES.get(tag, ()), "p"}:
                inside -= self._close(stack, old, near=True)
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.noise.append(_noise(tag, attributes, inside > 0))
            if tag in BLOCK:
                self.events.append((node, None))
            elif tag == "br":
                self.events.append((stack[-1], " "))
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}[\\s/>]", re.IGNORECASE).search(source, at)
                at = source.find(">", close.start()) + 1 or end if close else end
            elif tag not in VOID and not attributes.endswith("/"):
                self.open.setdefault(tag, []).append(len(stack))
                if tag in BLOCK:
                    self.blocks.append(len(stack))
                    if tag not in CLOSES and tag != "p":
                        self.containers.append(len(stack))
                stack.append(node)
                inside += tag in ("article", "main")
        if at < end:
            self._text(stack[-1], source[at:])

    def _text(self, node: int, raw: str) -> None:
        self.events.append((node, html.unescape(raw) if "&" in raw else raw))

    def _close(self, stack: list[int], tag: str, near: bool = False) -> int:
        """Close the innermost open ``tag``; how many article or main elements that ends.

        ``near``: only within the enclosing list, table or container. An inline element is not closed across a block.
        """
        at = self.open.get(tag)
        if not at:
            return 0
        depth = at[-1]
        barrier = self.containers if near else self.blocks if tag not in BLOCK else [0]
        if barrier[-1] > depth:
            return 0
        ended = 0
        for node in stack[depth:]:
            self.open[self.tags[node]].pop()
            ended += self.tags[node] in ("article", "main")
        for depths in (self.blocks, self.containers):
            while depths[-1] >= depth:
                depths.pop()
        del stack[depth:]
        if tag in BLOCK:
            self.events.append((stack[-1], None))
        return ended


def extract(source: str) -> str:
    """Main text of one page, its blocks joined by line breaks."""
    page = Page(source)
    n = len(page.tags)
    own = [0] * n
    for node, text in page.events:
        if text is not None:
            own[node] += len("".join(text.split()))
    # a noise element takes all below it along; what wraps the page does not count
    wraps = _wrappers(page, own)
    cut = [False] * n
    for node in range(1, n):
        cut[node] = cut[page.parents[node]] or (page.noise[node] != CLEAN and not wraps[node])
    chars = [0 if cut[i] else own[i] for i in range(n)]
    tags = [0 if cut[i] else 1 for i in range(n)]
    link = [page.tags[i] == "a" for i in range(n)]
    link_chars = [0] * n
    link_tags = [int(link[i] and not cut[i]) for i in range(n)]
    for node in range(n - 1, 0, -1):
        up = page.parents[node]
        if link[node]:
            link_chars[node] = chars[node]
        chars[up] += chars[node]
        tags[up] += tags[node]
        link_chars[up] += link_chars[node]
        link_tags[up] += link_tags[node]
    if not chars[0]:
        return ""
    share = link_chars[0] / chars[0]

    def density(i: int) -> float:
        if not chars[i]:
            return 0.0
        links, plain = max(1, link_chars[i]), max(1, chars[i] - link_chars[i])
        base = math.log(chars[i] / plain * link_chars[i] + share * chars[i] + math.e)
        ratio = chars[i] / links * max(1, tags[i]) / max(1, link_tags[i])
        adjusted = math.log(max(ratio, 1.0)) / math.log(max(base, 1.0) + 1.0)
        return chars[i] / max(1, tags[i]) * adjusted

    dense = [density(i) for i in range(n)]
    sums = [0.0] * n
    for node in range(1, n):
        sums[page.parents[node]] += dense[node]
    best = max(range(n), key=lambda i: (max(sums[i], 0.0 if any_child(i, page, chars) else dense[i]), -i)) if n > 1 else 0
    node, landmark = best, None
    while node:
        if page.tags[node] in ("article", "main"):
            landmark = node
        node = page.parents[node]
    if landmark is not None:
        return "\n".join(_blocks(page, {landmark}, cut))
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        if chars[i]:
            children.setdefault(page.parents[i], []).append(i)
    # lists of links among the paragraphs themselves
    for i in children.get(best, ()):
        if page.tags[i] != "p" and link_tags[i] > 1 and 2 * link_chars[i] > chars[i] and dense[i] < BESIDE * dense[best]:
            cut[i] = True
    for i in range(best + 1, n):
        cut[i] = cut[i] or cut[page.parents[i]]
    tops, node, largest = {best}, best, 0.0
    while node and page.tags[node] != "body":
        largest = max(largest, dense[node])
        for i in children.get(page.parents[node], ()):
            if i != node and (dense[i] >= BESIDE * largest or (i < node and not link_chars[i] and _is_heading(page, children, i))):
                tops.add(i)
        node = page.parents[node]
    return "\n".join(_blocks(page, tops, cut))


def _is_heading(page: Page, children: dict[int, list[int]], node: int) -> bool:
    """Whether all the text of an element lies in one heading."""
    while page.tags[node] not in HEADINGS:
        below = children.get(node, ())
        if len(below) != 1:
            return False
        node = below[0]
    return True


def _wrappers(page: Page, own: list[int]) -> list[bool]:
    """Which noise elements are kept: around every article or main element, around most of the unlinked text
    with no article beside, or of an ambiguous name and no thinner than the page. By tag, only forms around most of it."""
    n = len(page.tags)
    gone, linked, text, nodes, landmarks = [False] * n, [False] * n, [0] * n, [1] * n, [0] * n
    above, within = [0] * n, [False] * n
    for node in range(1, n):
        up, tag = page.parents[node], page.tags[node]
        gone[node] = gone[up] or (page.noise[node] == SURE and tag != "form")
        linked[node] = linked[up] or tag == "a"
        landmarks[node] = int(tag in ("article", "main") and not gone[node])
        above[node] = above[up] + landmarks[node]
        within[node] = within[up] or tag == "article"
    for node in range(n):
        text[node] = 0 if gone[node] or linked[node] else own[node]
    for node in range(n - 1, 0, -1):
        up = page.parents[node]
        text[up] += text[node]
        nodes[up] += nodes[node]
        landmarks[up] += landmarks[node]

    def keeps(node: int) -> bool:
        most = text[node] > WRAPS * text[0]
        if page.noise[node] == SURE:
            return page.tags[node] == "form" and most
        # articles within an article are mostly comments
        if not within[node] and landmarks[node] and landmarks[node] + above[node] == landmarks[0]:
            return True
        beside = landmarks[0] - landmarks[node] - above[node] > 0
        return (most and not beside) or (page.noise[node] == MAYBE and text[node] * nodes[0] >= text[0] * nodes[node] > 0)

    return [page.noise[node] != CLEAN and keeps(node) for node in range(n)]


def any_child(i: int, page: Page, chars: list[int]) -> bool:
    """Whether node ``i`` has an element after it that is its child; nodes are in page order."""
    return i + 1 < len(page.tags) and page.parents[i + 1] == i


def _blocks(page: Page, tops: set[int], cut: list[bool]) -> Iterator[str]:
    """Blocks of the elements ``tops``, in page order."""
    inside = [node in tops for node in range(len(page.tags))]
    for node in range(1, len(page.tags)):
        inside[node] = inside[node] or inside[page.parents[node]]
    run: list[str] = []
    for node, text in page.events:
        if text is None:
            if block := " ".join("".join(run).split()):
                yield block
            run = []
        elif inside[node] and not cut[node]:
            run.append(text)
    if block := " ".join("".join(run).split()):
        yield block


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html, or a page without article text: empty text, zero characters. Null ids
    and urls stay null; repeated pages are extracted each on their own; no rows give no rows.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "") for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    cols = [column(page_id).cast("bigint").alias("page_id"), column(url).cast("string").alias("url"), column(source)]
    return pages.select(*cols).mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")

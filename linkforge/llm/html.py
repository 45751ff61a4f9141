"""Main text of web pages by tag-path ratios.

A page is read into blocks of text.  Each block has a path: the block-level
tags from the root to it.  For each path the lengths, the punctuation and the
linked text of its blocks are summed and divided by their number; text and
punctuation ratios are fused into one weight, and paths whose weight reaches a
share of the best one carry content.  The element that holds most of their text
is the article.  Its paths' ratios are smoothed with its own, so that a short
heading, a list or a table counts as what it stands in, and those that reach a
share of it are returned.

Marks that authors leave (tags, roles and names of menus, footers, adverts,
comments and so on, or of articles) become part of the path and only scale its
weight; a page without any is read by its ratios alone.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe noframes noembed xmp plaintext textarea title".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("html head body td th tr tbody thead tfoot caption option optgroup legend summary".split())
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NEVER = frozenset("head button select svg math canvas audio video object datalist".split())
_MARKED = frozenset("nav footer aside form dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
#: Words of class or id names that mark what isn't an article's text.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice notices notification notifications alert alerts comment comments commentlist disqus respond replies reply sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar social share sharing related recommended recommendations newsletter subscribe subscription signup login search pagination pager widget widgets copyright disclaimer".split()
)
_HEADERS = frozenset({"header"})
_PUNCTUATION = re.compile(r"[.,;:!?\"'()…、。，！？；：¿¡–—]")
#: Share of the best path's weight from which a path carries content, and of the article's from which one in it is returned.
STRONG_SHARE, WEIGHT_SHARE = 0.2, 0.1
#: Share of the content's text that the article holds at least.
ARTICLE_SHARE = 0.7
#: What an author's mark scales a path's weight by.
NOT_CONTENT, CONTENT = 0.02, 3.0
#: A path in the article whose text is nearly all linked, short and hardly has punctuation is a menu.
MENU_LINKED, MENU_LENGTH = 0.9, 30
_HOLDERS = frozenset(["", *"html body main article section div center td form".split()])


@dataclass
class Block:
    path: str
    text: str
    linked: int
    node: int  # the block-level element it stands in


@dataclass
class Page:
    """Blocks in page order, and the block-level elements: tag and parent of each, the root first."""

    blocks: list[Block]
    tags: list[str]
    parents: list[int]


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(source)} if source.strip(" /\n\t") else {}


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")))


def _mark(tag: str, attributes: dict[str, str], inside: bool) -> str:
    """``!`` for an element that its author marks as something other than the article, ``+`` for an article's own."""
    role = attributes.get("role", "").lower()
    if tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody":
        return "+"
    if tag in _MARKED or tag in _HEADERS and not inside or role in _ROLES:
        return "!"
    if not attributes or tag in ("html", "body"):
        return ""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()))
    return "!" if words & _NAMES or not inside and words & _HEADERS else ""


def read_blocks(page: str) -> Page:
    """Blocks of text in page order, white space collapsed, without what a browser doesn't show as text."""
    out = Page([], [""], [-1])
    text: list[str] = []
    linked = 0
    # tag, left out, inside an article, path, within a link, nearest block-level element
    stack: list[tuple[str, bool, bool, str, bool, int]] = [("", False, False, "", False, 0)]

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.blocks.append(Block(stack[-1][3], joined, linked, stack[-1][5]))
            text.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][1]:
            decoded = html_lib.unescape(raw) if "&" in raw else raw
            text.append(decoded)
            if stack[-1][4]:
                linked += len(decoded.strip())

    def pop_to(index: int) -> None:
        if any(x[0] in _BLOCK for x in stack[index:]):
            flush()
        del stack[index:]

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                say(page[m.start() + 9 : m.end() - 3].replace("&", "&amp;"))
            continue
        if m[1] or m[4]:
            index = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if index:
                pop_to(index)
            elif tag in _BLOCK:
                flush()
            continue
        source = m[3] or m[6] or ""
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            if tag == "textarea":
                flush()
            continue
        if tag == "body":
            index = next((i for i in range(1, len(stack)) if stack[i][0] == "head"), 0)
            if index:
                pop_to(index)
        if tag in _CLOSES_P:
            index = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"), 0)
            if index:
                pop_to(index)
        if tag in _SIBLINGS:
            same, bound = _SIBLINGS[tag]
            first = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in bound:
                    break
                if stack[i][0] in same:
                    first = i
            if first:
                pop_to(first)
        if tag in _BLOCK:
            flush()
        if tag == "br":
            say(" ")
        if tag in _VOID or source.endswith("/") and tag not in _BLOCK:
            continue
        attributes = _attributes(source)
        _, dropped, inside, path, link, node = stack[-1]
        mark = _mark(tag, attributes, inside)
        if tag in _BLOCK:
            out.tags.append(tag)
            out.parents.append(node)
            node = len(out.tags) - 1
        path = f"{path}/{tag if tag in _BLOCK else ''}{mark}" if tag in _BLOCK or mark else path
        stack.append((tag, dropped or tag in _NEVER or _hidden(attributes), inside or mark == "+", path, link or tag == "a", node))
    flush()
    return out


@dataclass
class Ratios:
    """Sums over the blocks of a path, or over any set of blocks."""

    n: int = 0
    text: int = 0
    punctuation: int = 0
    linked: int = 0

    def add(self, block: Block) -> None:
        self.n += 1
        self.text += len(block.text)
        self.punctuation += len(_PUNCTUATION.findall(block.text))
        self.linked += block.linked

    def fused(self) -> float:
        """Text ratio, raised by the punctuation ratio and lowered by the share of linked text."""
        return self.text / self.n * (1 + self.punctuation / self.n) ** 0.5 * max(0.0, 1 - self.linked / self.text)


def _scale(path: str) -> float:
    """What the marks in a path do to its weight."""
    return NOT_CONTENT if "!" in path else CONTENT if "+" in path else 1.0


def _article(page: Page, strong: set[str]) -> int:
    """The innermost element that holds, in elements of its own, most of the text of the strong paths; an article's own mark counts more."""
    n = len(page.tags)
    own, below = [0.0] * n, [0.0] * n
    for b in page.blocks:
        if b.path in strong:
            own[b.node] += len(b.text) * _scale(b.path)
    for k in range(n - 1, 0, -1):
        below[page.parents[k]] += own[k] + below[k]
    total = own[0] + below[0]
    found = next((k for k in range(n - 1, -1, -1) if page.tags[k] in _HOLDERS and below[k] >= ARTICLE_SHARE * total), 0)
    # what stands beside it in the same article, or in the same element short of the whole page, is of it
    at = found
    while page.tags[at] not in ("", "html", "body"):
        if page.tags[at] in ("article", "main"):
            return at
        at = page.parents[at]
    return found


def content_blocks(page: Page) -> list[Block]:
    """The blocks that the tag-path ratios select, in page order."""
    sums: dict[str, Ratios] = {}
    for b in page.blocks:
        sums.setdefault(b.path, Ratios()).add(b)
    weights = {p: s.fused() * _scale(p) for p, s in sums.items()}
    best = max((w for p, w in weights.items() if "!" not in p), default=0.0)
    if not best:
        return []
    strong = {p for p, w in weights.items() if w >= STRONG_SHARE * best}
    article = _article(page, strong)
    inside = [False] * len(page.tags)
    for k in range(len(inside)):
        inside[k] = k == article or k > 0 and inside[page.parents[k]]
    blocks = [b for b in page.blocks if inside[b.node]]
    here: dict[str, Ratios] = {}
    whole = Ratios()
    for b in blocks:
        here.setdefault(b.path, Ratios()).add(b)
        if b.path in strong:
            whole.add(b)
    level = whole.fused()

    def smoothed(path: str, s: Ratios) -> float:
        menu = s.linked >= MENU_LINKED * s.text and s.text < MENU_LENGTH * s.n and 2 * s.punctuation < s.n
        return (s.fused() + level) / 2 * (NOT_CONTENT if "!" in path or menu else 1.0)

    kept = {p for p, s in here.items() if smoothed(p, s) >= WEIGHT_SHARE * level}
    return [b for b in blocks if b.path in kept]


def main_text(page: str | None) -> str:
    """The article's text: a block a line, in page order; empty for a page without any."""
    return "\n".join(b.text for b in content_blocks(read_blocks(page or "")))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page.

    A null or empty page has an empty text; ids and urls may be null or repeat;
    pages are read whole and one by one, so their length is bounded by a
    worker's memory only; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(f, f"_id {kinds['_id']}, _url {kinds['_url']}, text string, n_chars long")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")

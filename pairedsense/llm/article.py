"""Main text of web pages by composite text density.

A page is parsed once into its element tree (implied end tags, unclosed
elements and raw text as browsers take them; the walk is linear in the page).
Elements that are no article text by their kind or by their name (menus, page
heads and feet, sidebars, notices, adverts, forms, scripts, comments) are left
out. For every other element the density is

    C / T * log_b((C / LC) * (T / LT)),  b = ln(C * LC / (C - LC) + C * LCb / Cb + e)

with C characters, T tags, LC link characters and LT link tags below it, and Cb,
LCb those of the body; a count of 0 stands for 1. Of the containers the one whose
children's densities have the greatest sum is the article. The least density on
the path from it to the body is the threshold: a container beside the path that
has the same tag and class as the path there (the next section of an article
that is cut into several) is taken as well if its density reaches it, and half of
its mate's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|/([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# Blocks whose text is one passage: they are no article of their own.
PASSAGE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr figcaption caption summary legend tr address".split())
LISTS = frozenset("ul ol dl div section table menu p".split())
# Element kinds that hold no article text.
APART = frozenset(
    "head nav header footer aside menu dialog search form button select option textarea input label fieldset script style noscript template iframe object embed "
    "canvas svg math audio video map noembed noframes title xmp".split()
)
# First or last part of an element's id, class or role that marks it as no article text.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar aside complementary contentinfo cookie cookies consent gdpr notice notification alert disclaimer popup modal overlay comment comments commentlist disqus reply replies "
    "respond discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login register search toolbar widget widgets pager pagination "
    "skip skiplink form".split()
)
NOT_THESE = frozenset("with has no without is".split())
HEADED = frozenset("article entry post story content".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("title meta link base script style noscript template".split())
# Start tags that close an open element of these kinds, up to the nearest of the last set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


def _named_apart(tag: str, attributes: str) -> tuple[bool, str]:
    """(whether the names of an element mark it as no article text, its class)."""
    own, apart = "", False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "class":
            own = value
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            apart = True
        elif name in ("class", "id", "role"):
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                if not parts or parts[0] in NOT_THESE:
                    continue
                if "comment" in parts or "comments" in parts or parts[0] in NAMES or parts[-1] in NAMES and not (parts[-1] == "header" and parts[0] in HEADED):
                    apart = True
    return apart and tag not in ("html", "body", "main"), own


class Page:
    """Elements in page order (0 is the page itself) and what stands between their tags."""

    def __init__(self, html: str):
        self.tag, self.parent, self.apart, self.link, self.sign, self.last = ["#page"], [-1], [False], [False], [""], [0]
        self.pieces: list[tuple[int, str | None]] = []  # (element, text, or None where a block begins or ends)
        self._stack, self._open = [0], {}
        self._read(html)
        while self._stack:
            self._pop()

    def _pop(self) -> None:
        at = self._stack.pop()
        self.last[at] = len(self.tag) - 1
        self._open[self.tag[at]] = self._open.get(self.tag[at], 1) - 1
        if self.tag[at] in BLOCK:
            self.pieces.append((at, None))

    def _push(self, tag: str, attributes: str) -> int:
        at, up = len(self.tag), self._stack[-1]
        named, sign = _named_apart(tag, attributes) if attributes else (False, "")
        above = self.apart[up]
        if tag == "h1" and self.tag[up] == "header" and self._open.get("article"):
            above = self.apart[self.parent[up]]  # of an article's own head the title is its text
        self.apart.append(named or tag in APART or above)
        self.tag.append(tag)
        self.parent.append(up)
        self.link.append(tag == "a" or self.link[up])
        self.sign.append(sign)
        self.last.append(at)
        if tag in BLOCK:
            self.pieces.append((at, None))
        elif tag == "br":
            self.pieces.append((at, " "))
        if tag in ("article", "main", "h1") and self._open.get("form") and not named:
            self._keep_forms()
        return at

    def _keep_forms(self) -> None:
        """A form around the article is no form of the page."""
        kept = False
        for at in self._stack:
            if self.tag[at] == "form" and not self.apart[self.parent[at]]:
                self.apart[at], kept = False, True
            elif kept and self.tag[at] not in APART:
                self.apart[at] = False
        self.apart[-1] = self.apart[-1] and self.apart[self._stack[-1]]

    def _close(self, tags: frozenset, until: frozenset) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[i]]
            if name in tags:
                while len(self._stack) > i:
                    self._pop()
                return
            if name in until:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if self._open.get("head") and tag not in IN_HEAD:
            self._close(frozenset(["head"]), frozenset())
        if self._open.get("p") and tag in BLOCK:
            self._close(frozenset(["p"]), frozenset(["td", "th", "table", "button", "object"]))
        if tag in HEADINGS and self.tag[self._stack[-1]] in HEADINGS:
            self._pop()
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        at = self._push(tag, attributes)
        if tag not in VOID:
            self._stack.append(at)
            self._open[tag] = self._open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in ("body", "html"):
            return  # what follows is still shown
        if not self._open.get(tag):
            if tag == "p":
                self.pieces.append((self._stack[-1], None))
            return
        inline = tag not in BLOCK
        for i in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[i]]
            if name == tag:
                while len(self._stack) > i:
                    self._pop()
                return
            if inline and name in BLOCK:
                return

    def _text(self, text: str) -> None:
        if not text:
            return
        if self.tag[self._stack[-1]] == "head" and not text.isspace():
            self._pop()
        at = self._stack[-1]
        if not self.apart[at]:
            self.pieces.append((at, unescape(text) if "&" in text else text))

    def _read(self, html: str) -> None:
        at, find = 0, _TOKEN.search
        while True:
            m = find(html, at)
            if m is None:
                self._text(html[at:])
                return
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if tag in RAW:
                    end = RAW[tag].search(html, at)
                    at = end.start() if end else len(html)
                    continue
                self._start(tag, m[3])
            elif m[1]:
                self._end(m[1].lower())


def _densities(page: Page) -> tuple[list[float], list[float], list[int], list[int], int, list[int]]:
    """(density, sum of the children's densities, characters, link characters, the body, link tags) of the elements."""
    n = len(page.tag)
    chars, links, tags, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for at, text in page.pieces:
        if text is not None:
            size = len(" ".join(text.split()))
            chars[at] += size
            own[at] += size
            if page.link[at]:
                links[at] += size
    body = 0
    for i in range(n - 1, 0, -1):
        if page.tag[i] == "body":
            body = i
        if not page.apart[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    share = links[body] / chars[body] if chars[body] else 0.0
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        if page.apart[i] or not chars[i]:
            continue
        c, lc, t = chars[i], links[i], tags[i] or 1
        log = math.log(c / (lc or 1) * (t / (link_tags[i] or 1)))
        base = math.log(math.log(c * lc / ((c - lc) or 1) + share * c + math.e))
        density[i] = c / t * (log / base if base > 1e-9 else log)  # a page without links: the natural logarithm
        if i:
            sums[page.parent[i]] += density[i]
        if own[i] and page.tag[i] not in PASSAGE:
            sums[i] += own[i] * math.log(own[i] + 1)  # text of its own counts as one child without tags
    return density, sums, chars, links, body, link_tags


def main_text(html: str | None) -> str:
    """The article of one page: its blocks in page order, one per line, white space inside them as one space."""
    if not html:
        return ""
    page = Page(html)
    density, sums, chars, links, body, link_tags = _densities(page)
    if not chars[body]:
        return ""
    best = body
    for i in range(body, page.last[body] + 1):
        if not page.apart[i] and page.tag[i] in BLOCK and page.tag[i] not in PASSAGE and sums[i] and sums[i] >= sums[best]:
            best = i
    path = [best]
    while path[-1] > body:
        path.append(page.parent[path[-1]])
    threshold = min(density[i] for i in path)
    around = [i for i in path if page.tag[i] == "article"] or [i for i in path if page.tag[i] == "main"]
    if around:
        best = around[0]
        path = path[path.index(best) :]
    taken = {best}
    on_path = {page.parent[i]: i for i in path[:-1]}
    if not around:
        before: dict[int, int] = {}
        for i in range(body + 1, page.last[body] + 1):
            mate = on_path.get(page.parent[i])
            if mate is None or i == mate or page.apart[i]:
                continue
            if page.tag[i] == page.tag[mate] and page.sign[i] == page.sign[mate] and density[i] >= max(threshold, 0.5 * density[mate]):
                taken.add(i)
            if page.tag[i] == "h1" and i < mate:
                before[mate] = i
        if before and "h1" not in page.tag[best : page.last[best] + 1]:
            taken.add(max(before.values()))  # the title stands before the container of the text
    menus = [
        (i, page.last[i])
        for first in taken
        for i in range(first + 1, page.last[first] + 1)
        if link_tags[i] >= 3 and page.tag[i] in LISTS and not page.apart[i] and links[i] >= 0.9 * chars[i]
    ]
    blocks: list[str] = []
    parts: list[str] = []
    inside, gone = _covered([(i, page.last[i]) for i in taken]), _covered(menus)
    for at, text in page.pieces:
        if text is None:
            if parts:
                blocks.append(" ".join("".join(parts).split()))
                parts = []
        elif inside(at) and not page.apart[at] and not gone(at):
            parts.append(text)
    blocks.append(" ".join("".join(parts).split()))
    return "\n".join(b for b in blocks if b)


def _covered(spans: list[tuple[int, int]]):
    """Whether a number lies in one of the spans."""
    inside: set[int] = set()
    last = -1
    for a, b in sorted(spans):
        inside.update(range(max(a, last + 1), b + 1))
        last = max(last, b)
    return inside.__contains__


def _extract(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.schema.get_field_index("html"))
            keep = [batch.column(batch.schema.get_field_index(n)) for n in names]
            first, texts, size = 0, [], 0
            for i in range(len(html)):
                texts.append(main_text(html[i].as_py()))
                size += len(texts[-1])
                if size >= 4 << 20 or i == len(html) - 1:  # small pieces back to Spark, however long the pages are
                    made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*[c.slice(first, len(texts)) for c in keep], *made], names=[*names, "text", "n_chars"])
                    first, texts, size = i + 1, [], 0

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with text (the article, "" if there is none) and n_chars (its code points).

    Character references are decoded, white space inside a block is one space, the blocks are
    joined by one newline; nothing of the article is dropped or cut. ``br`` is white space.

    * A null or empty html, and a page without text outside of menus and the like, give "" and 0.
    * Rows are taken one by one: repeated rows stay, a null page_id or url stays, an empty table gives no rows.
    * Other columns stay; text and n_chars of the table's own are replaced.
    * A page is held by one task; time and memory are in proportion to its length.
    """
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in names)
    return pages.select(*names, "html").mapInArrow(_extract(names), f"{fields}, text string, n_chars long")

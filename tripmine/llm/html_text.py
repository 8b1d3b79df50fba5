"""Main text of web pages by tree scoring.

Each block of text gives points for its length and its commas to the element that
holds it, half of them one level up and less above; an element's points shrink with
the share of its text that is inside links. The best container is kept with those
siblings that score like content. Scripts, styles, forms, menus, page headers and
footers, sidebars, notices, adverts and comments give no text, wherever they are.

A block is a run of text between the tags of block elements; character references
are decoded, white space inside a block is one space, blocks are joined by a blank
line in page order. Pages are independent rows: null, empty and markup-only pages
have an empty text, broken or unclosed markup is read as far as it goes, repeated
rows are repeated. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from tripmine.llm.shingles import rows_of

_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small "
    "span strike strong sub sup time tt u var wbr math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = set(
    "script style noscript template head title iframe object svg canvas audio video nav footer aside form button "
    "select textarea input menu dialog".split()
)
_OUTSIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo|comments?|respond|disqus|sidebar|"
    r"side|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|notice|cookies?|consent|popup|modal|newsletter|subscribe|"
    r"subscription|share|sharing|social|related|recommended|widget|pagination|pager|toolbar|login|signup|search)(?:$|[\s_-])",
    re.I,
)
_CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
              "th": {"td", "th"}, "option": {"option"}}
_SCOPE = set("ul ol dl table td th article section main aside nav footer header form div body blockquote".split())
_PARAGRAPH = set("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption address summary caption".split())


class _Page(HTMLParser):
    """Elements (tag, parent, silent) and blocks [element, text, link characters]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, int, bool]] = [("", -1, False)]
        self.stack = [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.parts: list[str] = []
        self.linked, self.links = 0, 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                at = len(self.stack) - 1
                while at and self.elements[self.stack[at]][0] in _INLINE:
                    at -= 1
                self.blocks.append((self.stack[at], text, self.linked))
            self.parts, self.linked = [], 0

    def pop_to(self, at: int) -> None:
        for element in self.stack[at:]:
            self.links -= self.elements[element][0] == "a"
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag not in _INLINE:
            self.flush()
            closes = _CLOSED_BY.get(tag) or ({"p"} if tag not in _VOID else set())
            for at in range(len(self.stack) - 1, 0, -1):
                name = self.elements[self.stack[at]][0]
                if name in closes:
                    self.pop_to(at)
                    break
                if name in _SCOPE and name not in closes:
                    break
        if tag in _VOID:
            return
        up = self.stack[-1]
        silent = self.elements[up][2] or tag in _SILENT
        if not silent and tag not in ("html", "body", "article", "main"):
            named = " ".join(str(v) for k, v in attrs if k in ("class", "id", "role") and v)
            silent = bool(named and _OUTSIDE.search(named)) or "hidden" in dict(attrs)
            if tag == "header":
                silent = silent or not any(self.elements[e][0] in ("article", "main") for e in self.stack)
        self.elements.append((tag, up, silent))
        self.stack.append(len(self.elements) - 1)
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        for at in range(len(self.stack) - 1, 0, -1):
            name = self.elements[self.stack[at]][0]
            if name == tag:
                self.pop_to(at)
                break
            if tag in _INLINE and name not in _INLINE:
                break

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections of any name are skipped; one that is never closed takes the rest."""
        ends = [e + n for mark, n in (("]]>", 3), ("]>", 2)) if (e := self.rawdata.find(mark, i)) >= 0]
        if not ends and (e := self.rawdata.find(">", i)) >= 0:
            ends = [e + 1]
        return min(ends, default=-1)

    def handle_data(self, data: str) -> None:
        if not self.elements[self.stack[-1]][2]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    if page.rawdata.startswith(("<!", "<?")):
        page.rawdata = ""  # a comment or declaration that is never closed takes the rest
    page.close()
    page.flush()
    elements, blocks = page.elements, page.blocks
    points, size, linked = ([0.0] * len(elements) for _ in range(3))
    for element, text, links in blocks:
        worth = 1 + text.count(",") + min(len(text) / 100, 3)
        at = elements[element][1] if elements[element][0] in _PARAGRAPH and elements[element][1] > 0 else element
        part, level = worth, 1
        while at >= 0 and level < 6:
            points[at] += part
            level += 1
            part, at = worth / (2 if level == 2 else 3 * (level - 1)), elements[at][1]
        at = element
        while at >= 0:
            size[at] += len(text)
            linked[at] += min(links, len(text))
            at = elements[at][1]
    score = [p * (1 - k / s) if s else 0.0 for p, s, k in zip(points, size, linked, strict=True)]
    best = max(range(len(elements)), key=lambda e: (score[e] * (1.5 if elements[e][0] in ("article", "main") else 1), -e))
    if not size[best]:
        return ""
    # an article cut into sections is whole one level up
    while elements[best][0] not in ("article", "main") and (up := elements[best][1]) > 0:
        if elements[up][0] in ("body", "html") or linked[up] > 0.33 * size[up]:
            break
        best = up
    kept, up = {best}, elements[best][1]
    for e, (tag, parent, _) in enumerate(elements):
        if parent == up and e != best and size[e]:
            dense = linked[e] / size[e]
            prose = tag in _PARAGRAPH and size[e] > 80 and dense < 0.25
            if prose or score[e] >= max(10, 0.2 * score[best]):
                kept.add(e)

    def content(element: int) -> bool:
        while element >= 0:
            if element in kept:
                return True
            if elements[element][0] in ("ul", "ol", "table", "div", "section") and linked[element] > 0.5 * size[element]:
                return False
            element = elements[element][1]
        return False

    return "\n\n".join(text for element, text, _ in blocks if content(element))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``)."""
    rows = pages.selectExpr("CAST(page_id AS bigint) AS page_id", "url", "html")
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")

"""Web pages: title and text, directives, links and language versions, and the charset of raw bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.batches import some

_DROPPED = frozenset(("nav", "header", "footer", "script", "style", "noscript", "svg", "form"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em i kbd mark q s samp small span strong sub sup time u var wbr".split())
_CONTAINERS = ("main", "article", "body")


class _Page(HTMLParser):
    """Collects what a crawler needs in one pass."""

    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url = self.base = url
        self.stack: list[str] = []
        self.titles: dict[str, str] = {}
        self.texts: dict[str, list[str]] = {c: [] for c in _CONTAINERS}
        self.links: list[str] = []
        self.variants: list[str] = []
        self.canonical: str | None = None
        self.noindex = self.nofollow = self.in_language = False
        self.complete: set[str] = set()
        self.count: dict[str, int] = {}  # open elements by tag
        self.dropped = 0

    def put(self, text: str) -> None:
        if self.dropped:
            return
        for c in _CONTAINERS:
            if self.count.get(c) and c not in self.complete or c == "body" and not self.count.get("head") and not self.count.get("title"):
                self.texts[c].append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        rel = a.get("rel", "").lower().split()
        href = a.get("href", "").strip()
        if tag == "base" and href:
            self.base = urljoin(self.url, href)
        elif tag == "link" and "canonical" in rel and href:
            self.canonical = urljoin(self.base, href)
        elif tag == "link" and "alternate" in rel and "hreflang" in a and href:
            self.variants.append(urljoin(self.base, href))
        elif tag == "meta" and a.get("name", "").lower() == "robots":
            words = re.split(r"[\s,]+", a.get("content", "").lower())
            self.noindex |= "noindex" in words or "none" in words
            self.nofollow |= "nofollow" in words or "none" in words
        elif tag == "select":
            self.in_language = a.get("name") == "language"
        elif tag == "option" and self.in_language and a.get("value", "").strip().startswith(("http://", "https://")):
            self.variants.append(a["value"].strip())
        elif tag == "a" and href and "nofollow" not in rel and not href.startswith("#") and not href.lower().startswith(("mailto:", "tel:", "javascript:")):
            self.links.append(urljoin(self.base, href))
        if tag not in _INLINE:
            self.put("\n")
        if tag not in _VOID:
            self.stack.append(tag)
            self.count[tag] = self.count.get(tag, 0) + 1
            self.dropped += tag in _DROPPED

    def handle_endtag(self, tag: str) -> None:
        while self.count.get(tag):
            closed = self.stack.pop()
            self.count[closed] -= 1
            self.dropped -= closed in _DROPPED
            if closed == tag:
                break
        if tag in _CONTAINERS and not self.count.get(tag):
            self.complete.add(tag)  # of several the first counts
        if tag == "select":
            self.in_language = False
        if tag not in _INLINE:
            self.put("\n")

    def handle_data(self, data: str) -> None:
        for tag in ("title", "h1"):
            if self.count.get(tag) and f"{tag}done" not in self.titles:
                self.titles[tag] = self.titles.get(tag, "") + data
        self.put(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` sections are markup up to their end, whatever their keyword."""
        end = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        j = self.rawdata.find(end, i)
        return j + len(end) if j >= 0 else -1

    def title(self) -> str:
        """The ``title``, else the first ``h1``, else empty."""
        return next((t for t in (" ".join(self.titles.get(k, "").split()) for k in ("title", "h1")) if t), "")

    def content(self) -> str:
        for c in _CONTAINERS:
            text = "\n".join(x for x in (" ".join(line.split()) for line in "".join(self.texts[c]).split("\n")) if x)
            if text:
                return text
        return ""


def read_page(html: str, url: str = "") -> _Page:
    page = _Page(url)
    page.feed(html)
    page.close()
    return page


def parse_html(html: str) -> tuple[str, str]:
    """Title (``title``, else the first ``h1``, else empty) and text of main, else article, else body, lines kept."""
    page = read_page(html)
    return page.title(), page.content()


_META = re.compile(rb"""<meta[^>]+charset=["']?\s*([\w-]+)""", re.I)


def decode(content: bytes, content_type: str | None = None) -> str:
    """By the header's charset, else that of a meta tag in the first 4096 bytes, else UTF-8 with replacements."""
    header = re.search(r"charset=([\w-]+)", content_type or "", re.I)
    meta = _META.search(content[:4096])
    for name in (header and header[1], meta and meta[1].decode("ascii", "replace")):
        if name:
            try:
                return content.decode(name, "replace")
            except LookupError:
                continue
    return content.decode("utf-8", "replace")


_FIELDS = [("title", pa.string()), ("text", pa.string()), ("canonical", pa.string()), ("noindex", pa.bool_()), ("nofollow", pa.bool_()), ("links", pa.list_(pa.string())), ("variants", pa.list_(pa.string()))]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages by the megabyte, whatever the size of a batch."""
    for whole in batches:
        for batch in some(whole, pc.binary_length(whole.column("html"))):
            rows = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                page = read_page(html or "", url or "")
                rows.append((page.title(), page.content(), page.canonical, page.noindex, page.nofollow, page.links, list(dict.fromkeys(page.variants))))
            parsed = [pa.array([row[i] for row in rows], kind) for i, (_, kind) in enumerate(_FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *parsed], ["page_id", "url", *(name for name, _ in _FIELDS)])


def read_web_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (``page_id``, ``url``, ``html``) with title, text, directives, absolute links and language versions; parsed once."""
    schema = "page_id long, url string, title string, text string, canonical string, noindex boolean, nofollow boolean, links array<string>, variants array<string>"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_pages, schema)

"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams events; block elements cut the page in
lines. Each line has a ratio of text to tags, the ratios are smoothed with a
Gaussian along the page, and lines over a threshold (a share of the ratios'
standard deviation, so that it adapts to the page) form clusters. The clusters
select the content: the group that holds nearly all of their text is the
region, the groups in the region that no cluster touches and that are mostly
links go, and the rest of the region is given whole, short lines included.

Names of elements are a prior: text of elements that are never content (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments)
counts nothing, and an article is preferred to what is around it. Without any
such name the clusters alone decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import lean

#: Standard deviation of the Gaussian in lines, and the threshold in standard deviations of the smoothed ratios.
SIGMA, CUT = 1.0, 0.5
#: The region is the innermost group of blocks with at least this share of the clusters' text. The articles (or main) of a
#: page are preferred where they have at least the second share.
REGION_SHARE, ARTICLE_SHARE = 0.9, 0.25
#: A group that no cluster touches goes if at least this share of its text is in links.
LINK_SHARE = 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - {"option", "title", "head", "body", "html"}
#: Groups of blocks, which clusters judge as one.
_GROUPS = frozenset("aside blockquote details div dl fieldset figure form menu ol section table ul".split())
#: Never content, whatever the page; and what is not content unless its end tag is missing.
_NEVER = frozenset("button canvas dialog head iframe input label legend map noscript object script select style svg template textarea title video audio".split())
_ASIDE = frozenset("aside footer menu nav".split())
_ARTICLE = frozenset(("article", "main"))
#: Words of classes and IDs. A name rules an element out if it has one of the plain words, or one of the others with
#: nothing but these and words of layout beside it; the last ones do so only where they name a container.
_PLAIN = frozenset("advert adverts advertisement advertising sponsored gdpr newsletter disqus breadcrumb breadcrumbs pagination sidebar commentlist navbar cookiebar".split())
_WORDS = frozenset(
    "ad ads banner sponsor promo promotion cookie cookies consent notice notices popup modal overlay subscribe subscription signup nav navigation menu footer masthead comment comments".split()
)
_WEAK = frozenset("header pager respond reply replies share sharing social related recommended recommendations toolbar widget widgets".split())
_LAYOUT = frozenset(
    "area articles bar bottom box btn button buttons block container content fixed global google group holder inner item items left links list main mobile outer page panel posts primary reader row secondary section site slot sticky text top unit user users wrap wrapper right".split()
)
_CONTAINERS = _GROUPS | {"header", "nav"}
#: Names of elements that hold other articles than the page's own.
_HELD = _PLAIN | frozenset("ad ads aside banner comment comments promo promotion related recommended recommendations reply replies respond sponsor widget widgets".split())
#: With these a name says what is beside an element, not what it is.
_BESIDE = frozenset("has no not with without".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_NAME = re.compile(r"[^\s]+")
_WORD = re.compile(r"[a-z]+")
_OPENS = re.compile(r"<[a-zA-Z/!?]")


def _ruled_out(name: str, tag: str, in_article: bool) -> bool:
    """Whether one class or ID says that an element isn't content."""
    words = set(_WORD.findall(name.lower()))
    if words & _BESIDE:
        return False
    if words & _PLAIN:
        return True
    telling = _WORDS | (_WEAK - {"header"} if in_article else _WEAK) if tag in _CONTAINERS else _WORDS
    return bool(words & telling) and words <= _WORDS | _WEAK | _LAYOUT and (tag in _CONTAINERS or words <= _WORDS | _LAYOUT)


class _Lines(HTMLParser):
    """Lines of a page: pieces of text with the element that rules each out (0: none), tags, element, characters in links.

    Element 0 is the page itself. ``parent``, ``group`` (the innermost group
    that holds it) and ``article`` (the outermost article around it) are kept
    by element.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.group, self.article = [-1], [0], [0]
        self.open: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, element, what rules it out, in a link
        self.count: Counter[str] = Counter()  # open elements by tag
        self.unclosed: set[int] = set()  # elements that the end of the page closed
        self.hard: set[int] = set()  # elements that rule out text even so
        self.loose: set[int] = set()  # elements that an article may have got into by mistake
        self.forms: set[int] = set()
        self.lines: list[tuple[list[tuple[str, int]], int, int, int]] = []
        self.text: list[tuple[str, int]] = []
        self.tags = self.linked = 0

    def cut(self) -> None:
        if any(not piece.isspace() for piece, _ in self.text):
            self.lines.append((self.text, self.tags, self.open[-1][1], self.linked))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.cut()
            if tag in _CLOSES_P:
                self.close_open("p", stop=("article", "main", "section", "div", "td", "li", "body"))
            if tag == "li":
                self.close_open("li", stop=("ul", "ol", "menu"))
            elif tag == "option":
                self.close_open("option", stop=("select",))
        self.tags += 1
        if tag in _VOID:
            if tag == "br":
                self.text.append((" ", self.open[-1][2]))
            return
        _, above, out, linked = self.open[-1]
        number, article = len(self.parent), self.article[above]
        if tag == "main" and out not in self.hard or tag == "article" and out in self.loose:
            out = 0  # what is open around it was named after something else that it holds, or has lost its end tag
        if (not out or out in self.forms) and self.is_out(tag, attrs, article > 0):
            out = number
            if tag in _NEVER:
                self.hard.add(number)
            elif tag == "form":
                self.forms.add(number)
            elif tag not in ("aside", "footer") and _HELD.isdisjoint(_WORD.findall(" ".join(v or "" for k, v in attrs if k in ("class", "id")).lower())):
                self.loose.add(number)
        self.parent.append(above)
        self.group.append(number if tag in _GROUPS else self.group[above])
        self.article.append(article or (number if tag in _ARTICLE and not out else 0))
        self.open.append((tag, number, out, linked or tag == "a"))
        self.count[tag] += 1

    def is_out(self, tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
        if tag in _NEVER or tag in _ASIDE or tag == "form" or tag == "header" and not in_article:
            return True
        if tag in ("html", "body", "main"):
            return False
        for key, value in attrs:
            if key == "hidden" or key == "role" and (value or "").lower() in _ROLES:
                return True
            if key in ("class", "id") and value:
                names = _NAME.findall(value)
                # an article among several classes is an article whatever the others say
                if not (tag == "article" and len(names) > 1) and any(_ruled_out(n, tag, in_article) for n in names):
                    return True
        return False

    def pop(self, i: int) -> None:
        for tag, *_ in self.open[i:]:
            self.count[tag] -= 1
        del self.open[i:]

    def close_open(self, tag: str, stop: tuple[str, ...]) -> None:
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                return self.pop(i)
            if self.open[i][0] in stop:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.cut()
        self.tags += 1
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if tag in ("body", "html"):
                    self.unclosed.update(number for _, number, *_ in self.open[i + 1 :])
                return self.pop(i)

    def handle_data(self, data: str) -> None:
        _, _, out, linked = self.open[-1]
        if out not in self.hard:
            self.text.append((data, out))
            if linked and not out:
                self.linked += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` sections are markup up to their end, whatever their keyword."""
        end = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        j = self.rawdata.find(end, i)
        return j + len(end) if j >= 0 else -1

    def read(self, html: str) -> None:
        """Parse a whole page. A tag without an end at the end of the page is markup."""
        tail = html.rfind(">") + 1
        broken = _OPENS.search(html, tail)
        self.feed(html[: broken.start()] if broken else html)
        self.close()
        self.cut()
        self.unclosed.update(number for _, number, *_ in self.open)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines; at the ends the kernel is cut off and scaled."""
    radius = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    middle = slice(radius, radius + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def _up(own: np.ndarray, parent: list[int]) -> np.ndarray:
    """Sums over elements and all that they hold; an element comes after the one that holds it."""
    total = own.copy()
    for number in range(len(parent) - 1, 0, -1):
        total[parent[number]] += total[number]
    return total


def _select(page: _Lines, outs: set[int]) -> tuple[list[str], float]:
    """Lines of the content if ``outs`` rule text out, and the text of the clusters."""
    texts = [" ".join("".join(piece for piece, out in pieces if out not in outs).split()) for pieces, _, _, _ in page.lines]
    if not any(texts):
        return [], 0.0
    elements = len(page.parent)
    size = np.array([len(t) for t in texts], float)
    where = np.array([number for _, _, number, _ in page.lines])
    ratios = smooth(size / np.maximum(1, [tags for _, tags, _, _ in page.lines]))
    cluster = (ratios >= CUT * ratios.std()) & (size > 0)
    mass = _up(np.bincount(where, size * cluster, elements), page.parent)
    total = mass[0]
    article = np.array(page.article)[where]
    if size[article > 0].sum() and (size * cluster)[article > 0].sum() >= ARTICLE_SHARE * total:
        inside = article > 0
    else:
        region = page.group[int(np.flatnonzero(mass >= REGION_SHARE * total)[-1])]  # inner elements have larger numbers
        member = np.zeros(elements, bool)
        member[region] = True
        for number in range(region + 1, elements):
            member[number] = member[page.parent[number]]
        inside = member[where]
    # groups in the region that no cluster touches
    text = _up(np.bincount(where, size, elements), page.parent)
    links = _up(np.bincount(where, np.minimum(size, [linked for _, _, _, linked in page.lines]), elements), page.parent)
    apart = (mass == 0) & (text > 0) & (links >= LINK_SHARE * text)
    inside &= ~apart[np.array(page.group)[where]]
    return [t for t, kept in zip(texts, inside) if t and kept], float(total)


def extract(html: str | None) -> str:
    """The main text of a page: its blocks in page order, one a line; empty for null or where there is none.

    An element that only the end of the page closes rules nothing out but
    scripts and the like; a form is content where the page has more in forms
    than outside of them (some sites wrap whole pages in one).
    """
    if not html:
        return ""
    page = _Lines()
    page.read(html)
    if not page.lines:
        return ""
    outs = {out for pieces, *_ in page.lines for _, out in pieces if out and out not in page.unclosed}
    lines, total = _select(page, outs)
    if outs & page.forms:
        wrapped, more = _select(page, outs - page.forms)
        if more > 2 * total:
            lines = wrapped
    return "\n".join(lines)


def _extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [extract(h.as_py()) for h in part.column("html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages`` (``page_id``, ``url``, ``html``).

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a line feed; ``n_chars`` counts code points. A
    null or empty page, or one without content, has an empty text. Repeated
    rows and pages of any length are taken as they are; markup in any state is
    read as far as it goes, so that no page fails the job.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        lean(_extract_rows), "page_id long, url string, text string, n_chars long"
    )

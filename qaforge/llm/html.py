"""Main text of web pages by text-to-tag ratios over streaming parser events.

The standard library's parser sends events; texts are gathered into lines, one per block element. A line's ratio is its characters
over the tags since the line before. The ratios are smoothed by a Gaussian, and lines at or above the threshold (a share of their
standard deviation) form the content cluster. The region is selected from them: the article elements if any holds
clustered lines, or without such elements the stretch from the first to the last clustered line. Inside the region every line is kept, however short, and once an
article is selected every other one is.

Menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out before any ratio is taken: by element, by role, and
by class or id on elements that make up parts of a page (`PARTS`). A class or id tells such a part if one of its names consists of words for parts
beside the article and for containers only: `ad-box` does, `share-price` and `article-header` do not. Headings and inline elements are never left out for their names, paragraphs
only for a class that is a single unmistakable word. Formulas, labels, graphics and what stands in for an embedded object keep their text outside those parts.

Defined results: a null or empty page, or one with nothing but the left-out parts, has an empty text; unclosed elements end
with the element around them or with the page; equal pages give equal texts; input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from qaforge.llm.common import add_columns, arrow_schema, without

SIGMA, SHARE = 1.0, 0.5

BLOCKS = frozenset(
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav header footer aside form script style noscript template iframe head title menu dialog button select textarea".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
# Elements that make up parts of a page.
PARTS = frozenset("div section ul ol li dl table tbody tr td center details fieldset figure blockquote article main".split())
# Words of class and id names that mark parts beside the article.
ASIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus feedback footer form "
    "gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup popular promo promoted "
    "promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
# Words that may stand beside those in the name of a part.
CONTAINERS = frozenset(
    "area bar block body bottom box button buttons card cards center container content dialog global group home icons inner item items label large layer left links list lists "
    "main message mobile module outer page panel primary region reader right row secondary section shell site slot small stack sticky stories text the top unit user wrap wrapper".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
# Classes for which a paragraph is left out.
NOT_A_PARAGRAPH = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs cookie cookies copyright newsletter promo sponsored".split())
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
STRUCTURE = frozenset(("article", "main", "body", "html"))


def _names_part(value: str, inside: bool) -> bool:
    """Whether a class or id value has a name for a part beside the article; headers inside an article are its own."""
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        beside = [w for w in words if w in ASIDE_WORDS and not (inside and w in ("header", "masthead"))]
        if beside and all(w in ASIDE_WORDS or w in CONTAINERS for w in words):
            return True
    return False


def _beside(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    for name, value in attrs:
        if not value:
            if name == "hidden":
                return True
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name not in ("class", "id"):
            continue
        if tag in ("article", "main"):
            # An article is left out as a reader's comment only.
            if any(w.lower() in COMMENT_WORDS for w in WORDS.findall(value)) and _names_part(value, inside):
                return True
        elif tag in PARTS and _names_part(value, inside):
            return True
        elif tag == "p" and name == "class" and any(x.lower() in NOT_A_PARAGRAPH for x in value.split()):
            return True
    return False


class Lines(HTMLParser):
    """Lines of text with the tags before them and the article element they stand in (0: none)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.stack: list[str] = []
        self.open: dict[str, list[int]] = {}  # depths at which each element is open
        self.walls: list[int] = []  # depths of open elements that no other end tag closes
        self.skip = 0  # depth of the stack at which a left-out part began, plus one
        self.articles: list[int] = []  # depths of open article elements
        self.article = self.made = 0
        self.tags = 0
        self.parts: list[str] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.lines.append((text, self.tags, self.article))
            self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip:
            if tag == "body" and "head" in self.stack[self.skip - 1 : self.skip]:
                self.pop_to(self.skip - 1)
            else:
                if tag not in VOID:
                    self.push(tag)
                return
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            if self.stack and self.stack[-1] == "p" and tag != "br":
                self.pop_to(len(self.stack) - 1)
        if tag in VOID:
            return
        inside = bool(self.articles)
        self.push(tag)
        if (tag in LEFT_OUT and not (tag == "header" and inside)) or (attrs and _beside(tag, attrs, inside)):
            self.end_line()
            self.skip = len(self.stack)
        elif tag in ("article", "main"):
            if not inside:
                self.made += 1
                self.article = self.made
            self.articles.append(len(self.stack))

    def push(self, tag: str) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in STRUCTURE:
            self.walls.append(len(self.stack))
        self.stack.append(tag)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop()
            self.open[tag].pop()
            if tag in STRUCTURE:
                self.walls.pop()
        if self.skip > depth:
            self.skip = 0
        while self.articles and self.articles[-1] > depth:
            self.articles.pop()
        if not self.articles:
            self.article = 0

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS and not self.skip:
            self.end_line()
        if not self.skip:
            self.tags += 1
        # An end tag without a partner, or with one beyond the structure around it, closes nothing.
        at = self.open.get(tag)
        if not at or (tag not in STRUCTURE and self.walls and self.walls[-1] > at[-1]):
            return
        if self.skip > at[-1] or tag in STRUCTURE:
            self.end_line()
        self.pop_to(at[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)

    def done(self) -> list[tuple[str, int, int]]:
        self.close()
        self.end_line()
        return self.lines


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the borders the kernel is cut and its weights are raised to sum to one."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]
    return np.convolve(values, kernel)[radius : radius + len(values)] / weight


def content_lines(lines: list[tuple[str, int, int]], sigma: float = SIGMA, share: float = SHARE) -> np.ndarray:
    """Which lines belong to the content."""
    chars = np.array([len(t) for t, _, _ in lines], dtype="float64")
    ratios = smooth(chars / np.maximum([n for _, n, _ in lines], 1), sigma)
    cluster = ratios >= share * ratios.std()
    article = np.array([a for _, _, a in lines])
    if (article[cluster] > 0).any():
        return article > 0
    at = np.flatnonzero(cluster)
    keep = np.zeros(len(lines), dtype=bool)
    if len(at):
        keep[at[0] : at[-1] + 1] = True
    return keep


def main_text(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.done()
    if not lines:
        return ""
    keep = content_lines(lines)
    return " ".join(t for (t, _, _), k in zip(lines, keep) if k)


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page, and `n_chars`, its code points; the page itself is dropped."""
    rows = without(pages, [out, "n_chars"] if html.lower() not in (out.lower(), "n_chars") else [])
    kept = [f for f in rows.schema.fields if f.name.lower() != html.lower()]
    schema = T.StructType(kept + [T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])
    arrow = arrow_schema(schema)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(html)]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], schema=arrow)

    return rows.mapInArrow(extract, schema)

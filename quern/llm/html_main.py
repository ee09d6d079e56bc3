r"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering.

A page is streamed through the standard library's HTML parser. Block elements cut its text
into lines; each line counts its characters and the tags met while it was read, and
belongs to a region: the outermost article or main element around it, or else the
nearest sectioning element. What never holds main text is left out as it is met: scripts,
styles, menus, page headers and footers, sidebars, forms, and elements whose role, class
or id names an advert, a notice, reader comments and the like. A name is a whole word of
class or id, or, for an element without sections in it or one within an article, the first or
last part of one. A form or an element with such a role or name that contains an article or
main is a wrapper and leaves nothing out, save an article's own comments and related articles; nor does a form, menu, sidebar or footer in an article that is never closed,
as it would take the rest of the article.

The ratios of characters to tags of a page's lines are smoothed by a Gaussian. Regions of
one container whose text is alike, mostly in links or mostly not, are taken together, and
their ratio is the mean of their lines' by their characters. A threshold between the two
clusters of ratios (two means) selects, if the clusters are apart: the lower one goes where
its text is mostly in links, which is what menus and lists of teasers are made of; other
short paragraphs, headings and lists of an article stay. Where a page has article or main
elements only those are candidates, and the best region always stays. All lines of a
selected region are kept, in page order.

One narrow pass, no shuffle; memory is one page's lines, and time grows with lines and regions.

Defined results: a null page counts as empty and gives empty text; a page without tags is
one line; pages of any length are read whole; what is no markup is text; of regions with equal
ratios all count alike, and of equally good ones the first stays for certain; repeated rows give
equal rows; an empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import batch, mapped, small_batches, texts

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SECTION = frozenset("article main section div td body html center fieldset details".split())
_BLOCK = _SECTION | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr th figure figcaption address hr".split())
_NEVER = frozenset("head title script style noscript template svg math button select textarea iframe object dialog menu audio video canvas".split())
#: Elements that are named by their tag: what they hold is left out if they are closed, or stand outside articles.
_TAGGED = frozenset("form nav footer aside".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation footer header masthead breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login paywall share sharing social related recommended recirculation "
    "comment comments disqus respond replies pagination pager toolbar widget hidden".split()
)
#: Of these, what holds other articles and comments within an article.
_OTHERS = frozenset("related recommended recirculation comment comments disqus respond replies".split())
#: A word with one of these parts says how a page is laid out, not what an element is.
_LAYOUT = frozenset("no not non with without has have is js".split())
_WORDS = re.compile(r"[^a-z0-9_\-]+")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: An element of these closes an open paragraph, as pages leave out </p>.
_CLOSES_P = _BLOCK | frozenset("nav footer aside form header".split())

#: How sure a name is: a part of a word, a whole word or role, a tag, an element that is not shown.
PART, NAME, TAG, HIDDEN = 1, 2, 3, 4

#: Standard deviation, in lines, of the smoothing, and its reach.
SIGMA, REACH = 1.0, 2
#: Share of a region's characters in links from which it may be a menu.
MENU = 0.5


class Lines(HTMLParser):
    """Cuts a page into lines: (text, characters, tags, region, article, name, characters in links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, int, int]] = []
        #: Open elements that matter: tag, whether it leaves out, region, whether in main (1) or an article (2), place in ``named``.
        self.stack: list[tuple[str, bool, int, int, int]] = [("", False, 0, 0, 0)]
        #: Elements with a name: the one around, how sure the name is (0 if it leaves nothing out), whether in an
        #: article, and whether a section (1) or article (2) was met in it.
        self.named: list[list[int]] = [[0, 0, 0, 0]]
        self.regions, self.parts, self.tags = 0, [], 0
        #: The region around each region; characters in links so far, and open elements at an open link's start.
        self.around, self.linked, self.link = [0], 0, 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, _, region, article, name = self.stack[-1]
            self.lines.append((text, len(text), max(1, self.tags), region, article > 0, name, min(self.linked, len(text))))
            self.tags = 0
        self.parts, self.linked = [], 0

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of no known kind is a comment
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in _VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.cut()
            return
        if tag in _CLOSES_P and self.stack[-1][0] == "p":
            self.cut()
            self.stack.pop()
        _, out, region, article, name = self.stack[-1]
        strength = self._strength(tag, attrs, article == 2)
        leaves = tag in _NEVER or (tag == "header" and not article) or strength == HIDDEN
        if tag == "a":
            self.link = len(self.stack)
        if leaves or strength or tag in _BLOCK or tag == "header":
            if not out:
                self.cut()
                if not leaves and not strength and tag in _SECTION:
                    self._contains(tag)
            if strength and not leaves:
                self.named.append([name, strength, article == 2, 0])
                name = len(self.named) - 1
            if tag in _SECTION and not article:
                self.regions += 1
                self.around.append(0 if tag in ("html", "body") else region)
                region = self.regions
            if tag in ("article", "main") and not leaves:
                article = max(article, 2 if tag == "article" else 1)
            self.stack.append((tag, out or leaves, region, article, name))

    def _contains(self, tag) -> None:
        """Named elements around a section that show to be wrappers leave nothing out."""
        k, met = self.stack[-1][4], 2 if tag in ("article", "main") else 1
        while k and self.named[k][3] < met:
            around, strength, article, _ = self.named[k]
            if strength != TAG and (met == 2 or (strength == PART and not article)):
                self.named[k][1] = 0
            self.named[k][3] = met
            k = around

    def _strength(self, tag, attrs, article) -> int:
        """How an element is named as what never holds main text; 0 if it isn't."""
        if tag in ("html", "body", "article", "main"):
            names = [v for k, v in attrs if k in ("class", "id") and v] if tag == "article" else []
            return HIDDEN if any(x in ("comment", "comments", "ad", "advert", "advertisement") for v in names for x in re.split(r"[^a-z0-9]+", v.lower())) else 0
        found = NAME if tag == "form" else TAG if tag in _TAGGED else 0
        for k, v in attrs:
            if not v:
                if k == "hidden":
                    return HIDDEN
            elif (k == "role" and v.lower().strip() in _ROLES) or (k == "aria-hidden" and v.lower() == "true"):
                found = NAME
            elif k in ("class", "id"):
                for word in _WORDS.split(v.lower()):
                    parts = re.split(r"[_\-]+", word)
                    ends = {parts[0], parts[-1]} & _NAMES if _LAYOUT.isdisjoint(parts) else set()
                    if article:
                        ends.discard("header")  # an article's own
                        if ends & _OTHERS:
                            return HIDDEN
                    if ends:
                        found = max(found, NAME if len(parts) == 1 else PART)
        return found

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.link = 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                if not self.stack[-1][1]:
                    self.cut()
                # text that an element leaves out never got in
                self._unclosed(k + 1)
                del self.stack[k:]
                if k < self.link:
                    self.link = 0
                return
        if tag == "p" and not self.stack[-1][1]:
            self.cut()

    def _unclosed(self, k) -> None:
        """Of open elements from ``k`` on, which end with the one around them, those that are
        named by their tag hold the rest of their article, so they leave nothing out."""
        for (tag, *_, name), (*_, around) in zip(self.stack[k:], self.stack[k - 1 :], strict=False):
            if tag in _TAGGED and name != around and self.named[name][2]:
                self.named[name][1] = 0

    def handle_data(self, data):
        if not self.stack[-1][1]:
            self.parts.append(data)
            if self.link:
                self.linked += len(" ".join(data.split()))

    def read(self, html: str) -> list[tuple[str, int, int, int, bool, int, int]]:
        self.feed(html)
        self.close()
        self.cut()
        self._unclosed(1)
        out = [False]  # an element stands after the one around it
        for around, strength, *_ in self.named[1:]:
            out.append(out[around] or strength > 0)
        return [x for x in self.lines if not out[x[5]]]


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """Ratios of lines under a Gaussian; at the ends its weights are of what is there."""
    k = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    full = lambda v: np.convolve(v, k)[REACH : REACH + len(v)]
    return full(ratio) / full(np.ones(len(ratio)))


def threshold(x: np.ndarray) -> float:
    """The middle between the means of two clusters of values."""
    low, high = float(x.min()), float(x.max())
    for _ in range(30):
        cut = (low + high) / 2
        below, above = x[x <= cut], x[x > cut]
        if not len(below) or not len(above):
            break
        low, high = float(below.mean()), float(above.mean())
    return (low + high) / 2


def main_text(html: str) -> str:
    """The blocks of a page's main text, joined by an empty line."""
    page = Lines()
    lines = page.read(html)
    if not lines:
        return ""
    size, tags, linked = (np.array([x[k] for x in lines], float) for k in (1, 2, 6))
    region, article = np.array([x[3] for x in lines]), np.array([x[4] for x in lines])
    ratio = smoothed(size / tags)
    pool = article if article.any() else np.ones(len(lines), bool)
    names, of = np.unique(region[pool], return_inverse=True)
    weight, links = np.bincount(of, size[pool]), np.bincount(of, linked[pool])
    menu = links >= MENU * weight
    # regions of one container are alike or not by where their text is
    _, group = np.unique(np.column_stack([np.array(page.around)[names], menu]), axis=0, return_inverse=True)
    group = group.ravel()[of]
    weight, links = np.bincount(group, size[pool]), np.bincount(group, linked[pool])
    score = np.bincount(group, size[pool] * ratio[pool]) / weight
    chosen = (score >= threshold(score)) | (links < MENU * weight)
    chosen[np.argmax(score * np.sqrt(weight))] = True
    return "\n\n".join(lines[i][0] for i, g in zip(np.flatnonzero(pool), group, strict=True) if chosen[g])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
        for b in batches:
            found = [main_text(t) for t in texts(b.column(2))]
            yield batch(schema, page_id=b.column(0), url=b.column(1), text=found, n_chars=list(map(len, found)))

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return mapped(rows, run, "page_id long, url string, text string, n_chars long", "html_main")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

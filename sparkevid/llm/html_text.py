"""HTML extraction: content regions by text-to-tag ratio.

The standard library's parser streams events into lines, one for each block element. Each line has a ratio of
its characters to its tags (characters in links count against it). Ratios are smoothed by a Gaussian and split in two
clusters by a threshold. A line's weight is its text times what its smoothed ratio has above the threshold; menus, adverts and
footers have none or next to none.

* The region is the smallest element that holds 19 twentieths (``SHARE``) of the weight. If that is more than the whole page, its lines are the text,
  whatever the elements and their names.
* Names (tags, classes, ids, roles) decide what the ratio cannot. Comments, sidebars and recommendations are as dense as an article, so
  they go by name. If the ratio finds no element below the page, up to ``TIES`` dense lines with names of menus, adverts, headers or footers
  go and the region is looked for again; where more are dense, the ratio is trusted.
* A name does not make furniture of an element that holds the dense text of its page; a word that only modifies another ("legal-news") needs
  half as much dense text as there is elsewhere.
* Short blocks of the region belong to it, and so do headings and paragraphs that stand beside it or an element around it. Rows of links
  go, unless they are an ordered list, as references are. Of a header in the region or beside it the heading stays, and of one
  within it a lead.

By their tags only scripts, styles, forms and what HTML itself sets apart take no part. Time is
linear in the page, however deep its elements.

Null and empty pages give an empty text. Unclosed and misnested elements are closed where HTML's rules or the
enclosing end tag close them. Repeated rows are extracted each for itself; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import on_executors, table

#: HTML's elements without content, block elements, elements apart from the main text, headings, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
APART = frozenset("script style noscript template head title form button select textarea input iframe object svg canvas audio video dialog search fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table select article section div body html main".split())
CONTENT = frozenset(("article", "main"))
PAGE = frozenset(("body", "html"))
#: Elements that can be a region.
HOLDERS = CONTENT | PAGE | frozenset("section div td table center blockquote".split())
#: Elements that are furniture by their tag, if not by the ratio.
FURNITURE = frozenset("nav header footer aside menu".split())
#: Words of class names and ids that hint at furniture.
WORDS = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|aside|widget\w*|footer\w*|foot|header|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|notification\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter|subscribe\w*|subscription|signup|login|share|sharing|social\w*|related\w*|recommend\w*|trending|pagination|pager|copyright|legal|disclaimer|comments?|commentlist|disqus\w*|replies|reply|respond|discussion|skip|hidden|tags|meta|byline",
    re.I,
)
#: Those of furniture that reads like an article.
DISCOURSE = re.compile(r"side|aside|sidebar\w*|widget\w*|related\w*|recommend\w*|trending|comments?|commentlist|disqus\w*|replies|reply|respond|discussion", re.I)
#: Names that tell of a layout, as "with-sidebar" does, not of the element itself.
LAYOUT = re.compile(r"(?:with|without|has|no|hide|show|layout)[_-]", re.I)
PARTS = re.compile(r"[_-]+")

#: Elements that count as content beside the region as well.
BESIDE = HEADINGS | frozenset("p blockquote pre".split())

#: Standard deviation of the smoothing, in lines.
SIGMA = 0.5
#: Share of the weight that the region holds, and dense lines of furniture that names may take from it.
SHARE, TIES = 0.95, 2
#: Characters from which a paragraph of an article's header is a lead.
LEAD = 60
#: Lines in a row that are nearly all links from which they are a menu.
ROW = 3
#: A page whose dense text all has names of furniture has its article there if it is so many times the other text.
RESCUE = 4
NOT, LOOSE, FIRM = 0, 1, 2


def hinted(names: str) -> int:
    """FIRM where a name is or ends in a word of furniture, LOOSE where one only has it, else NOT."""
    found = NOT
    for name in names.split():
        if not LAYOUT.match(name):
            parts = [p for p in PARTS.split(name) if p]
            if parts and WORDS.fullmatch(parts[-1]):
                return FIRM
            if any(map(WORDS.fullmatch, parts[:-1])):
                found = LOOSE
    return found


class Lines(HTMLParser):
    """Lines of a page, and the elements around them; elements are numbered as they open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, number, whether apart, nearest named element, outermost article or main, whether in a link, nearest block.
        self.stack: list[tuple[str, int, bool, int, int, bool, int]] = []
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.scopes: list[int] = []
        self.parents: list[int] = []
        self.kinds: list[str] = []
        self.ends: list[int] = []
        self.named: dict[int, tuple[int, int]] = {}  # named element to the one around it and its hint
        self.heads: set[int] = set()  # headers, of the page or of an article
        self.discourse: set[int] = set()  # named elements that read like an article, and those inside them
        self.text: list[str] = []
        self.inside: list[tuple[int, int, int, int]] = []  # of a line: element, named, article, block
        self.tags: list[int] = []
        self.links: list[int] = []
        self._parts: list[str] = []
        self._tags = self._linked = 0

    def _flush(self) -> None:
        if self._parts:
            line = " ".join("".join(self._parts).split())
            if line:
                self.text.append(line)
                _, number, _, named, main, _, block = self.stack[-1] if self.stack else ("", -1, False, -1, -1, False, -1)
                self.inside.append((number, named, main, block))
                self.tags.append(self._tags)
                self.links.append(self._linked)
            self._parts.clear()
        self._tags = self._linked = 0

    def _pop(self, depth: int) -> None:
        if any(x[0] in BLOCK for x in self.stack[depth:]):
            self._flush()
        while len(self.stack) > depth:
            tag, number, *_ = self.stack.pop()
            self.ends[number] = len(self.kinds)
            self.open[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def _innermost(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of these, or -1; none beyond the innermost scope."""
        at = max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)
        return at if at > (self.scopes[-1] if self.scopes else -1) else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
            if (at := self._innermost(("p",))) >= 0:  # a block ends an open paragraph
                self._pop(at)
        if tag in CLOSES and (at := self._innermost(CLOSES[tag])) >= 0:
            self._pop(at)
        self._tags += 1
        if tag == "br":
            self._parts.append(" ")
        if tag in VOID:
            return
        number = len(self.kinds)
        _, parent, apart, named, main, link, block = self.stack[-1] if self.stack else ("", -1, False, -1, -1, False, -1)
        if tag in APART:
            apart = True
        if not apart and tag not in CONTENT and tag not in PAGE:
            given = dict(attrs)
            apart = "hidden" in given or given.get("aria-hidden") == "true"
            names = f"{given.get('class') or ''} {given.get('id') or ''}"
            hint = FIRM if tag in FURNITURE or (given.get("role") or "").lower() in ROLES else hinted(names)
            if hint:
                if tag == "header" or "header" in PARTS.split(names.lower().replace(" ", "-")):
                    self.heads.add(number)
                if tag == "aside" or named in self.discourse or any(map(DISCOURSE.fullmatch, PARTS.split(names.replace(" ", "-")))):
                    self.discourse.add(number)
                self.named[number] = (named, hint)
                named = number
        self.parents.append(parent)
        self.kinds.append(tag)
        self.ends.append(-1)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, number, apart, named, number if main < 0 and tag in CONTENT else main, link or tag == "a", number if tag in BLOCK else block))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if self.open.get(tag):
            self._pop(self.open[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][2]:
            return
        self._parts.append(data)
        if self.stack and self.stack[-1][5]:
            self._linked += len(data)

    def finish(self) -> None:
        self.close()
        self._flush()
        self._pop(0)


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, with weights renormalised at the ends."""
    if len(x) < 2 or sigma <= 0:
        return x
    reach = int(3 * sigma)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return (np.convolve(x, kernel, "full") / np.convolve(np.ones(len(x)), kernel, "full"))[reach : reach + len(x)]


def threshold(x: np.ndarray) -> float:
    """The cut between two clusters of least squared error (one-dimensional 2-means, solved exactly)."""
    v = np.sort(x)
    if len(v) < 2 or v[0] == v[-1]:
        return float(v[0]) if len(v) else 0.0
    n, s, q = np.arange(1, len(v)), np.cumsum(v)[:-1], np.cumsum(v * v)[:-1]
    total, squares = v.sum(), (v * v).sum()
    error = (q - s * s / n) + ((squares - q) - (total - s) ** 2 / (len(v) - n))
    i = int(np.argmin(np.where(v[1:] > v[:-1], error, np.inf)))
    return float((v[i] + v[i + 1]) / 2)


def furniture(lines: Lines, dense: list[float], plain: list[float]) -> set[int]:
    """The named elements that are furniture; ``dense``, ``plain``: characters of each line if it is dense, and in any case, links left out."""
    inside: dict[int, float] = dict.fromkeys(lines.named, 0.0)
    elsewhere = rest = 0.0
    for (_, named, _, _), d, p in zip(lines.inside, dense, plain, strict=True):
        if named >= 0:
            inside[named] += d
        else:
            elsewhere, rest = elsewhere + d, rest + p
    for number in sorted(inside, reverse=True):
        if (around := lines.named[number][0]) >= 0:
            inside[around] += inside[number]
    above = set()
    if not elsewhere and inside:  # all dense text has a name: the element of most of it may be the article, the inner one of equals
        at = max(inside, key=lambda e: (inside[e], lines.named[e][1] == LOOSE, e))
        if inside[at] >= RESCUE * rest and not any(main >= 0 and named < 0 for _, named, main, _ in lines.inside):
            rest = inside[at]
            while at >= 0:
                above.add(at)
                at = lines.named[at][0]
    out: set[int] = set()
    for number, (around, hint) in lines.named.items():
        if around in out or (number not in above and (hint == FIRM or 2 * inside[number] < (elsewhere or rest))):
            out.add(number)
    return out


def holder(lines: Lines, element: np.ndarray, weight: np.ndarray) -> int:
    """The smallest element that can be a region and holds SHARE of the weight; -1 for the page itself.

    Elements are numbered as they open, so an element's lines are those whose numbers lie in its range, and those around a line's
    element have lower numbers."""
    order = np.argsort(element, kind="stable")
    numbers, upto = element[order], np.concatenate(([0.0], np.cumsum(weight[order])))
    least = SHARE * upto[-1] - 1e-9
    ranges = np.searchsorted(numbers, np.array([np.arange(len(lines.kinds)), lines.ends]))
    held = upto[ranges[1]] - upto[ranges[0]] if len(lines.kinds) else np.empty(0)
    found = np.flatnonzero(held >= least)
    at = int(found[-1]) if len(found) else -1
    while at >= 0 and lines.kinds[at] not in HOLDERS:
        at = lines.parents[at]
    return at


def extract(html: str) -> str:
    """The main text of a page."""
    if not html:
        return ""
    lines = Lines()
    lines.feed(html)
    lines.finish()
    if not lines.text:
        return ""
    size = np.array([len(t) for t in lines.text], float)
    links = np.array(lines.links)
    plain = np.maximum(size - links, 0)
    smooth = smoothed(plain / (1 + np.array(lines.tags)))
    cut = threshold(smooth)
    dense = smooth >= cut
    weight = np.where(dense, smooth - cut, 0.0) * plain
    if not weight.any():
        weight = np.where(dense, plain, 0.0)  # one line, or all alike
    element, named, _, block = np.array(lines.inside).T
    out = furniture(lines, np.where(dense, plain, 0.0).tolist(), plain.tolist())
    apart = np.isin(named, list(out))
    talk = np.isin(named, list(out & lines.discourse))
    if (weight * ~talk).any():
        weight = weight * ~talk
    region = holder(lines, element, weight)
    taken = apart & ~dense | talk
    if region < 0 or lines.kinds[region] in PAGE:
        ties = apart & dense & ~talk
        rest = weight * ~ties
        if not rest.any():
            rest = plain * ~apart  # an article shorter than the adverts around it
        if ties.sum() <= TIES and rest.any():
            taken |= ties
            region = holder(lines, element, rest)

    above, at = {-1}, region
    while at >= 0:
        above.add(at)
        at = lines.parents[at]
    within = np.ones(len(size), bool) if region < 0 else (element >= region) & (element < lines.ends[region])
    if region >= 0 and lines.kinds[region] not in PAGE:  # its own header, or one beside it in an element of both
        head = np.isin(named, list(lines.heads)) & ~talk
        shared = {k for k in above if k >= 0 and lines.kinds[k] not in PAGE}
        heading = np.array([b >= 0 and lines.kinds[b] in HEADINGS for b in block.tolist()])
        near = np.array([n >= 0 and lines.parents[n] in shared for n in named.tolist()])
        within |= head & near & heading
        taken &= ~(head & within & (heading | (size >= LEAD)))
    stays = within & ~taken
    beside = np.array([b >= 0 and lines.kinds[b] in BESIDE and lines.parents[b] in above for b in block.tolist()])
    stays |= beside & ~apart & (2 * links < size)
    linked = links >= 0.8 * size
    ordered = np.array([b >= 0 and lines.kinds[b] == "li" and lines.kinds[lines.parents[b]] == "ol" for b in block.tolist()])
    edges = np.flatnonzero(np.diff(np.concatenate(([False], linked & ~ordered, [False])).astype(np.int8)))
    for a, b in edges.reshape(-1, 2).tolist():
        if b - a >= ROW:
            stays[a:b] = False
    return "\n".join(lines.text[i] for i in np.flatnonzero(stays).tolist())


def page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the text of each page; the other columns stay."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = pa.array([extract(x.as_py() or "") for x in part.column("html")], pa.string())
            rest = [c for c in part.schema.names if c != "html"]
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in rest} | {"text": texts})


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and the text of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(on_executors("html_text", "page_texts"), "page_id long, url string, text string")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))

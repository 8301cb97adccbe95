"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clustering.

Each run of text between block tags is a line. Its ratio is its characters over the tags met since the line before, times the share
that is not in links, and nearly nothing in parts that names or tags show to be around an article. Ratios are
smoothed along the page and cut; the lines over the cut are the cluster of content, and it chooses the region: the article or
main elements where they hold most of it, else the smallest container with most of it, else its stretch of lines. Parts around the
article are never in the text, whatever their ratio.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that start and end a line, that have no end tag, and whose contents are never shown as text (fixed values).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("canvas datalist head iframe noscript object script select style svg template textarea title".split())
#: Elements around an article whatever they hold, and those that are so unless they hold most of the page's paragraphs (fixed values).
AROUND_TAGS, FORM_TAGS = frozenset("aside button footer menu nav".split()), frozenset("dialog form header".split())
#: Elements whose text is left out of the line that they are in.
MUTED = NO_TEXT - {"head"} | {"button"}
MAIN = frozenset(["article", "main"])  # as tags and as roles
HEADS, PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("blockquote p pre".split())
CONTAINERS = frozenset("article center div main section table tbody td".split())
#: Parts of class names, ids and roles of what surrounds an article, and of an article that is a reader's (fixed values).
AROUND = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navigation|navbar|menu|breadcrumbs?|footer|contentinfo|sidebar|side|complementary|widgets?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|dialog|comments?|commentlist|respond|replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|form|pagination|pager|skip|toolbar|header|masthead|topbar)(?:$|[\s_-])", re.I)
REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|login)(?:$|[\s_-])", re.I)
READERS = re.compile(r"(?:^|\s)(?:comment|reply)(?:$|[\s_-])", re.I)
#: Width of the smoothing kernel in lines, and what a line around the article counts of its ratio.
SIGMA, REACH, FAINT = 1.0, 2, 0.05


class Lines(HTMLParser):
    """The lines of a page, one for each run of text between block tags, and the elements they are in.

    A line is (text, tags met since the line before, element, characters in links). Elements are numbered as they are met;
    parent, tag and around (0, 1: unless it holds most of the page, 2: whatever it holds, 3: never text, 4: unless it holds the article,
    5: unless it holds most of the page's paragraphs) are lists by number.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.tag, self.parent, self.around, self.main = ["#root"], [0], [0], [0]
        self.open, self.count = [0], {}
        self.parts: list[str] = []
        self.tags = self.linked = self.muted = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.open[-1], min(self.linked, len(text))))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in VOID:
            self.parts.append(" " if tag in ("br", "hr", "wbr", "img") else "")
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCKS:
            self.flush()
            if tag == "body":
                self.close_open("head", set())
            self.close_open("p", {"article", "main", "div", "section", "body", "td", "th", "li", "blockquote", "aside", "form"})
            if tag in ("li", "dt", "dd", "td", "th", "tr"):
                self.close_open(tag, {"ul", "ol", "dl", "table", "body"} | ({"tr"} if tag in ("td", "th") else set()))
        up = self.open[-1]
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "")) for k, v in attrs)
        reader = bool(names and READERS.search(names))
        is_main = (tag in MAIN or any(k == "role" and v in MAIN for k, v in attrs)) and not reader
        if tag in NO_TEXT:
            around = 3
        elif tag in AROUND_TAGS:
            around = 2
        elif is_main or tag in ("html", "body"):
            around = 0
        elif reader or hidden or (names and REMARKS.search(names)):
            around = 4
        elif tag in FORM_TAGS and not (tag == "header" and self.main[up]):
            around = 5
        else:
            around = int(bool(names and AROUND.search(names)))
        here = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.around.append(around)
        self.main.append(self.main[up] or (here if is_main else 0))
        self.open.append(here)
        self.count[tag] = self.count.get(tag, 0) + 1
        self.muted += tag in MUTED

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def close_open(self, tag: str, limits: set) -> None:
        """Closes the innermost open element of this tag and all inside it, unless one of limits is met first."""
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[i]] == tag:
                for e in self.open[i:]:
                    self.count[self.tag[e]] -= 1
                    self.muted -= self.tag[e] in MUTED
                del self.open[i:]
                return
            if self.tag[self.open[i]] in limits:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag not in VOID:
            self.close_open(tag, {"article", "main", "body", "nav", "footer", "aside"} if tag not in BLOCKS or tag == "p" else {"html"})

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.parts.append(data)
            if self.count.get("a"):
                self.linked += len(data.strip())


def smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing whose weights sum to one at the ends too."""
    k = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    part = slice(REACH, REACH + len(values))
    return np.convolve(values, k)[part] / np.convolve(np.ones(len(values)), k)[part]


def content_lines(ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Which lines belong to the cluster of high ratios, and the cut: half a standard deviation of the smoothed ratios."""
    soft = smoothed(ratio)
    cut = min(0.5 * float(soft.std()), float(soft.max()))
    return soft >= cut, cut


def parsed(html: str) -> Lines:
    page = Lines()
    try:
        page.feed(html)
        page.close()
    except AssertionError:  # marked sections that the parser does not know
        page = Lines()
        page.feed(re.sub(r"<!\[[^>]*>?", "", html))
        page.close()
    page.flush()
    return page


def faint_elements(page: Lines) -> np.ndarray:
    """By element: 1 if it or one it is in is around the article, 2 if it is never text. Names do not count against an element that holds
    an article or main element, or over half of the page's text, nor form tags against one with over half of its
    paragraphs; remarks and notices are around the article however long they are."""
    n = len(page.tag)
    chars, prose, holds = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, dtype=bool)
    for text, _, e, _ in page.lines:
        chars[e] += len(text)
        prose[e] += len(text) * (page.tag[e] in PARAGRAPHS)
    for e in range(n - 1, 0, -1):
        if page.around[e] == 3:
            chars[e] = prose[e] = 0
        holds[e] |= page.main[e] == e
        chars[page.parent[e]] += chars[e]
        prose[page.parent[e]] += prose[e]
        holds[page.parent[e]] |= holds[e]
    faint = np.zeros(n, np.int8)
    for e in range(1, n):
        kind = page.around[e]
        freed = holds[e] or (kind == 1 and 2 * chars[e] > chars[0]) or (kind == 5 and 2 * prose[e] > chars[0])
        own = 2 if kind == 3 else int(kind == 2 or (kind > 0 and not freed))
        faint[e] = max(own, faint[page.parent[e]])
    return faint


def main_text(html: str | None) -> str:
    """The article of a page: the lines of the regions that hold the cluster of content lines.

    Where article and main elements have at least half of the content's characters, the regions are the outermost of them with a quarter
    or more of what the fullest has. Else such elements are cards beside the article, and the region is the smallest container of several
    other lines that has four fifths of their content's characters; where only the body has, the stretch of lines from
    the first content line to the last, where lines at either end count that are headings or over the cut themselves and not mostly
    links. In a region all lines are kept but those around the article, and lines at its ends that are under the cut and mostly links.
    """
    page = parsed(html or "")
    faint = faint_elements(page)
    lines = [x for x in page.lines if faint[x[2]] < 2]
    if not lines:
        return ""
    size, tags, at, linked = (np.array(v) for v in zip(*((len(t), n, e, a) for t, n, e, a in lines)))
    plain = faint[at] == 0
    if not plain.any():
        return ""
    ratio = size / np.maximum(1, tags) * np.where(plain, 1.0, FAINT) * (1 - 0.9 * linked / size)
    chosen, cut = content_lines(ratio)
    chosen = chosen & plain if (chosen & plain).any() else plain
    main = np.array(page.main)[at]
    weight = np.bincount(main[chosen], size[chosen], len(page.tag))
    if 2 * weight[1:].sum() >= weight.sum():
        region = plain & (main > 0) & (4 * weight[main] >= weight[1:].max())
    else:
        plain, chosen = plain & (main == 0), chosen & (main == 0)
        region = plain & _held(page, size, at, plain, chosen, ratio, linked, cut)
    weak = region & ~chosen & (2 * linked > size)
    inner = np.flatnonzero(region & ~weak)
    if not len(inner):
        inner = np.flatnonzero(region)
    region[: inner[0]] = region[inner[-1] + 1 :] = False
    return "\n".join(x[0] for x, k in zip(lines, region) if k)


def _held(page: Lines, size, at, plain, chosen, ratio, linked, cut: float) -> np.ndarray:
    """The lines of the smallest container that holds the content, or else of the content's stretch."""
    n = len(page.tag)
    weight, held = np.bincount(at[chosen], size[chosen], n), np.bincount(at[plain], minlength=n)
    for e in range(n - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
        held[page.parent[e]] += held[e]
    fit = [e for e in range(1, n) if page.tag[e] in CONTAINERS and held[e] > 1 and 5 * weight[e] >= 4 * weight[0]]
    if fit:
        inside = np.zeros(n, dtype=bool)
        inside[fit[-1]] = True
        for e in range(fit[-1] + 1, n):
            inside[e] = inside[page.parent[e]]
        return inside[at]
    heads = np.array([page.tag[e] in HEADS for e in at])
    ends = np.flatnonzero(chosen & (2 * linked <= size) & (heads | (ratio >= cut)))
    ends = ends if len(ends) else np.flatnonzero(chosen)
    return (np.arange(len(size)) >= ends[0]) & (np.arange(len(size)) <= ends[-1])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, text, n_chars (its code points).

    Null and empty pages, and pages of tags only, give the empty text. Character references are decoded, white space
    within a line becomes one space, lines are joined by a newline in page order; nothing else is dropped
    and no length is capped. Ids and urls are passed on as they are, nulls and repeats too.
    Pages whose lines are all alike are kept whole, as no ratio is under the cut then; equal pages have equal texts. One pass without
    a shuffle; a page is held in memory on its own, and time is in proportion to its length however deep it nests.
    """

    def run(batches):
        for batch in batches:
            text = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, type=pa.string())], names=["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))

"""Main text of HTML pages by text-to-tag ratios (operator 5).

The standard library's streaming parser turns a page into lines, one for each block of text.
A line's ratio of characters to tags, smoothed by a Gaussian along the page, and a threshold on
it cluster lines into content and the rest. The regions that hold the content lines are the
text, their short lines too: the page's outermost articles where no content lies outside them,
else the innermost element that holds all content lines. Runs of links below the threshold are
menus and go, inside an article only if they read like labels. A form goes if it asks for something and is not around
the text itself. Elements that by tag or role are navigation and the like never become lines. A class
or id is evidence only: outside an article it removes an element if it says nothing else or if
the ratio rejects the element too, inside one only if both speak against it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.rows import trimmed

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
NEVER = frozenset(
    "head title script style noscript template nav aside footer button select option textarea input datalist iframe object "
    "embed applet svg canvas audio video menu dialog map".split()
)
#: A block start closes an open element of these kinds, as in the HTML standard's optional end tags.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "body", "html"}
#: Where the search for an element to close by rule ends.
BARRIER = frozenset("ul ol dl table article section main div body".split())
#: What a form asks with; hidden fields ask nothing.
FIELDS = frozenset("input select textarea button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner banners cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars aside widget widgets related recommended recommendations "
    "share sharing social nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager header masthead topbar footer copyright colophon "
    "comment comments commentlist discussion disqus replies reply respond login toolbar skip disclaimer".split()
)
#: Words that say nothing about an element's kind, so that ``site-footer`` is a footer and ``related-work`` is not what is related.
PLAIN = frozenset(
    "site page main top bottom left right global box bar wrap wrapper container block area section inner outer text list item items link links row col column unit slot "
    "button buttons panel group holder module region icon icons form area zone message popover js id the and".split()
)
HEADERS = frozenset({"header", "masthead"})
#: Names that inside an article, too, are of nothing that belongs to its text.
STRANGERS = frozenset(
    "ad ads adsense advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
    "sidebar share sharing social breadcrumb breadcrumbs pagination pager login".split()
)
#: Words that a name may end in without a hyphen: ``adbox``, ``navwrap``.
JOINED = re.compile(r"(box|bar|wrap|wrapper|container|block|slot|unit|panel|banner)$")
#: The last line of a page that says whose it is.
COPYRIGHT = re.compile(r"(©|\(c\)|copyright\b|all rights reserved).{0,200}$", re.IGNORECASE | re.DOTALL)
#: Texts by readers, which no ratio tells from the article's.
READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
HOLDERS = frozenset("article main section div td body".split())
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Line:
    text: str
    tags: int
    holder: int  # the innermost open holder, -1 for none
    doubt: int = -1  # the innermost open element that a name speaks against
    linked: bool = False  # all of its text is in links
    form: int = -1  # the open form
    title: bool = False  # in an h1


@dataclass
class _Open:
    tag: str
    skipped: bool
    holder: int
    doubt: int


@dataclass
class LineParser(HTMLParser):
    """Collects the lines of a page from parser events; keeps a stack of open elements only.

    Elements that matter later are numbered in the order they open, and know their parents by number.
    """

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.open: Counter = Counter()  # how many elements of each tag are open
        self.chunks: list[str] = []
        self.tags = self.letters = self.link_letters = 0
        self.holders: list[int] = []  # parent of each holder
        self.top: list[int] = []  # the outermost article or main element around each holder, -1 for none
        self.doubts: list[int] = []  # parent of each doubtful element
        self.forms: list[list] = []  # of each form, whether it asks for something, and whether it holds a heading or an article
        self.form = -1

    def _break(self) -> None:
        text = _SPACE.sub(" ", "".join(self.chunks)).strip()
        if text:
            last = self.stack[-1] if self.stack else None
            linked = self.letters > 0 and self.letters == self.link_letters
            self.lines.append(Line(text, self.tags, last.holder if last else -1, last.doubt if last else -1, linked, self.form, self.open["h1"] > 0))
            self.tags = 0
        self.chunks, self.letters, self.link_letters = [], 0, 0

    def _skipping(self) -> bool:
        return bool(self.stack) and self.stack[-1].skipped

    def _unwanted(self, tag: str, attrs: dict[str, str]) -> bool | None:
        """Whether the element goes; None where the ratio has to say."""
        if tag in NEVER or (tag in ("label", "legend") and self.form >= 0):
            return True
        if tag in ("html", "body", "main"):
            return False
        inside = self.open["article"] + self.open["main"] > 0
        if tag == "header":
            return not inside
        if "hidden" in attrs or _HIDDEN.search(attrs.get("style", "").lower()) or attrs.get("role", "").lower() in ROLES:
            return True
        if tag not in BLOCKS and tag != "span" and tag != "ins":
            return False
        names = (attrs.get("class", "") + " " + attrs.get("id", "")).lower()
        if tag == "article":
            return bool({"comment", "comments", "ad", "advert", "promo"} & set(names.split()))
        sure = unsure = False
        for token in names.split():
            words = {part for word in _WORD.findall(token) for part in _parts(word)}
            named = words & NAMES - (HEADERS if inside else frozenset())
            if named and words <= NAMES | PLAIN:
                if not self.open["article"] or named & (READERS | STRANGERS):
                    return True
                sure = True
            unsure = unsure or bool(named)
        return None if sure or (unsure and not inside) else False

    def _close(self, k: int) -> None:
        self._break()
        self._pop(k)

    def _pop(self, k: int) -> None:
        for e in self.stack[k:]:
            self.open[e.tag] -= 1
        del self.stack[k:]
        if not self.open["form"]:
            self.form = -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in CLOSES_P and self.open["p"] and not (self._skipping() and tag in NEVER):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag == "p":
                    self._close(k)
                    break
                if self.stack[k].tag in BARRIER:
                    break
        if tag in CLOSES and any(self.open[t] for t in CLOSES[tag]):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag in CLOSES[tag]:
                    self._close(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif self.stack[k].tag in BARRIER:
                    break
        if tag in BLOCKS:
            self._break()
        if self.form >= 0 and not self._skipping():
            if tag in FIELDS and dict(attrs).get("type", "").lower() != "hidden":
                self.forms[self.form][0] = True
            self.forms[self.form][1] |= tag in HEADINGS or tag in ("article", "main")
        if tag in VOID:
            return
        unwanted = self._skipping() or self._unwanted(tag, {k: v or "" for k, v in attrs})
        skipped = bool(unwanted)
        if tag == "form" and not skipped and self.form < 0:
            self.forms.append([False, False])
            self.form = len(self.forms) - 1
        holder, doubt = (self.stack[-1].holder, self.stack[-1].doubt) if self.stack else (-1, -1)
        if unwanted is None:
            self.doubts.append(doubt)
            doubt = len(self.doubts) - 1
        if tag in HOLDERS and not skipped:
            self.holders.append(holder)
            above = self.top[holder] if holder >= 0 else -1
            holder = len(self.holders) - 1
            self.top.append(above if above >= 0 or tag not in ("article", "main") else holder)
        self.stack.append(_Open(tag, skipped, holder, doubt))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1].tag == tag and tag in ("script", "style", "iframe", "svg"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for k in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[k].tag == tag:
                if tag in BLOCKS:
                    self._close(k)
                else:
                    self._pop(k)
                return
            # An inline end tag does not reach out of its block.
            if tag not in BLOCKS and self.stack[k].tag in BLOCKS:
                return
        if tag in BLOCKS:
            self._break()

    def handle_data(self, data: str) -> None:
        if not self._skipping():
            self.chunks.append(data)
            letters = sum(map(str.isalnum, data))
            self.letters += letters
            self.link_letters += letters if self.open["a"] else 0

    def finish(self) -> None:
        """End the page. A tag that nothing closes up to there is no text, as browsers have it; it is not looked into
        again for tags inside, each of which would be sought to the end."""
        if self.rawdata.startswith("<") and self.rawdata[1:2] in _OPENS:
            self.rawdata = ""
        self.close()
        self._break()


#: What makes of a ``<`` the start of a tag, comment or declaration.
_OPENS = frozenset("!?/abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _parts(word: str) -> list[str]:
    """A name's words; ``adbox`` is an ad and a box."""
    end = JOINED.search(word)
    return [word[: end.start()], end.group()] if end and word not in NAMES and word[: end.start()] in NAMES else [word]


def without_forms(lines: list[Line], forms: list[list]) -> list[Line]:
    """Without the lines of forms that ask for something, unless such a form holds a heading, an article or most of the page."""
    size = Counter()
    for line in lines:
        size[line.form] += len(line.text)
    whole = sum(size.values())
    gone = {k for k, (asks, holds) in enumerate(forms) if asks and not holds and 2 * size[k] <= whole}
    return [line for line in lines if line.form not in gone]


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing, normalised at the ends."""
    radius = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[radius:-radius] / np.convolve(np.ones_like(ratios), kernel)[radius:-radius]


def sure_lines(lines: list[Line], doubts: list[int]) -> list[Line]:
    """Without the lines of doubtful elements whose characters to tags are below half the mean ratio of the
    other lines. ``doubts`` has the parent of each such element."""
    depth = [0] * len(doubts)
    for k, parent in enumerate(doubts):
        depth[k] = 1 + (depth[parent] if parent >= 0 else 0)
    deep = lambda line: depth[line.doubt] if line.doubt >= 0 else 0
    least = min(map(deep, lines), default=0)
    plain = [line for line in lines if deep(line) == least]  # where a name is around all, those with no more than that
    if len(plain) == len(lines):
        return lines
    others = [len(line.text) / max(1, line.tags) for line in plain]
    around = {line.doubt for line in plain}
    chars, tags = [0] * len(doubts), [0] * len(doubts)
    for line in lines:
        if line.doubt >= 0:
            chars[line.doubt] += len(line.text)
            tags[line.doubt] += line.tags
    for k in range(len(doubts) - 1, -1, -1):  # an element's parent opens before it
        if doubts[k] >= 0:
            chars[doubts[k]] += chars[k]
            tags[doubts[k]] += tags[k]
    low = [False] * len(doubts)
    for k, parent in enumerate(doubts):
        rejected = chars[k] > 0 and depth[k] > least and k not in around and chars[k] / max(1, tags[k]) < np.mean(others) / 2
        low[k] = rejected or (parent >= 0 and low[parent])
    return [line for line in lines if line.doubt < 0 or not low[line.doubt]]


def content_lines(lines: list[Line]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines' smoothed ratio of characters to tags reaches the threshold that parts the page's lines
    in two, and which do so by their own ratio."""
    ratios = np.array([len(line.text) / max(1, line.tags) for line in lines])
    ratio = smoothed(ratios)
    threshold = min(ratio.mean(), ratio.std()) if ratio.std() > 0 else 0.0
    content = ratio >= threshold
    return content if content.any() else np.ones(len(lines), bool), ratios >= threshold


def without_menus(lines: list[Line], content: np.ndarray, inside: list[bool]) -> list[bool]:
    """Which lines are no part of a menu: a run of three or more lines that are links and nothing else, none of them content
    by itself. ``inside`` an article a list of links may be its sources, and is a menu only if its links are
    labels of two words at most."""
    keep, at = [True] * len(lines), 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end].linked and not content[end]:
            end += 1
        labels = all(len(line.text.split()) <= 2 for line in lines[at:end])
        if end - at >= 3 and (labels or not all(inside[at:end])):
            keep[at:end] = [False] * (end - at)
        at = max(end, at + 1)
    return keep


def main_lines(parser: LineParser) -> list[Line]:
    """The lines of the regions that hold the content.

    Lines whose smoothed ratio reaches the threshold are content. Where none of them lies outside
    the page's outermost articles and main elements, all of those are the text. Else it is the
    innermost element that holds all content lines. Menus inside are left out. An ``h1`` before articles that have
    none is their title; a last line of copyright outside of them is the page's.
    """
    lines = sure_lines(without_forms(parser.lines, parser.forms), parser.doubts)
    while lines and COPYRIGHT.match(lines[-1].text) and (lines[-1].holder < 0 or parser.top[lines[-1].holder] < 0):
        lines = lines[:-1]
    if not lines:
        return []
    content, alone = content_lines(lines)
    top = [parser.top[line.holder] if line.holder >= 0 else -1 for line in lines]
    keep = without_menus(lines, alone, [t >= 0 for t in top])
    if all(t >= 0 for t, c in zip(top, content, strict=True) if c):
        chosen = [t >= 0 for t in top]
        titles = [k for k, line in enumerate(lines) if line.title]
        if len(titles) == 1 and titles[0] < chosen.index(True):
            chosen[titles[0]] = True
    else:
        around = _common(parser.holders, [line.holder for line, c in zip(lines, content, strict=True) if c])
        within = [k == around for k in range(len(parser.holders))]
        for k, parent in enumerate(parser.holders):
            within[k] = within[k] or (parent >= 0 and within[parent])
        chosen = [around < 0 or (line.holder >= 0 and within[line.holder]) for line in lines]
    return [line for line, c, k in zip(lines, chosen, keep, strict=True) if c and k]


def _common(parents: list[int], holders: list[int]) -> int:
    """The innermost holder around all of ``holders``, -1 for none."""
    if min(holders) < 0:
        return -1
    inside = [0] * len(parents)
    for holder in holders:
        inside[holder] += 1
    for k in range(len(parents) - 1, -1, -1):
        if inside[k] == len(holders):
            return k
        if parents[k] >= 0:
            inside[parents[k]] += inside[k]
    return -1


def extract(html: str | None) -> str:
    """The main text of one page, blocks joined by one space; empty where there is none."""
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.finish()
    return " ".join(line.text for line in main_lines(parser))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text``, ``n_chars`` (code points of the text).

    Null html counts as empty and gives an empty text; null ids and urls stay; repeated rows
    are each extracted; an empty table gives no rows; other columns are ignored. A page is
    parsed as a stream, and one page's lines are all that is held.
    """
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=out)

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(trimmed(work), "page_id long, url string, text string, n_chars long")

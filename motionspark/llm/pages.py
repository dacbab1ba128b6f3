"""Operator 1: main text of web pages.

The standard library's streaming parser gives events; they are gathered into lines, one a block element,
each with its text, the tags met in it and how much of its text is linked. A line's text-to-tag ratio is
smoothed with a Gaussian kernel over its neighbours, and lines whose smoothed ratio reaches a threshold
(a share of the ratios' standard deviation) form content clusters. Elements that are never part of an
article (menus, scripts, hidden ones and so on) open no lines at all.

Others are left out on the word of their class, id or role, as those are named for what they hold ("ad",
"cookie-banner") but also for what stands beside or around it ("has-sidebar", "nav-open") or for a page builder's
blocks ("post-widget"). So such an element is judged when the page is over, by its share of the text of the nearest
``article`` or ``main`` around it, or of the page: it stays with nearly all of it under a plain name, half of it under a
compound one, whose word counts only where it comes last. Elements of one name in an article or main are judged together,
and on a page together if they hold nearly all of it; an element beside articles of more than a little text goes.
Reader comments go whatever their share, if the rest of the page holds prose; their text counts nowhere. Paragraphs, headings
and the like go for few names only, and names inside ``pre`` and ``code`` say nothing. A kept element's inner elements are
judged in turn.

The content region runs from the first to the last line of the clusters, with headings just before it.
``article`` and ``main`` elements bound the clusters where at least half of the clusters' text stands in them
(then the share of their ratios' geometric mean caps the threshold, lest one long block hide the short ones);
otherwise the clusters decide alone, and the content element is the innermost that holds most of their text. The region
is extended to the first and the last plain line (no inner tags, not linked) of the bound or of the content element, so
short paragraphs stay; where the content element is the whole body, only to lines beside those of the clusters. In a bound, one or
two other short lines beside a cluster belong to it. A line that is mostly links is no part of the region unless, in a
bound, it is a heading, an item of a list after text, or its own ratio reaches the threshold.

Broken markup costs linear time: what follows a tag, comment or declaration that never ends is mended once (open quotes are
taken out of its tags, unfinished tags go) and its text stays.

Defined cases: null or empty html gives empty text and 0 characters; a page without any cluster falls back
to all its lines; unclosed and stray tags are tolerated; repeated rows are each extracted; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import small_batches

SIGMA = 2.0
SHARE = 0.25
LINKED = 0.6
BOUND = 0.5

# Names in HTML.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("applet aside audio button canvas dialog embed footer frame frameset head iframe input label map math menu meter nav noscript object progress script search select style svg template textarea title video".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_HINTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs byline-share captcha comment comments commentlist consent cookie cookies cookiebar disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paywall popup promo promos promoted promotion recommended related replies respond share sharing sidebar sidebars signup skip skyscraper social sponsor sponsored sponsors subscribe subscription teaser toolbar topbar warning widget widgets".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Names that say nothing about an element of text.
_WEAK = frozenset("banner banners footer masthead overlay promoted recommended related social sponsor sponsored sponsors teaser warning widget widgets".split())
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
_SIBLING_TEXTS = _TEXTS | frozenset("li dd dt".split())
#: What may stand beside a hint in a plain name, and what makes a name one of a state or of a neighbour.
_HOLDERS = frozenset("area bar block body bottom box button buttons container content element footer form group header inner item items left link links list middle outer panel posts right section slot text title top unit wrap wrapper zone".split())
_STATES = frozenset("active closed collapsed disabled enabled has hidden hide is no not off on open show sticky toggle visible with without".split())
#: Shares of the page's text that an element of a plain name, or of a compound one, must hold to stay.
NEARLY_ALL = 0.9
HALF = 0.5
#: Characters outside reader comments that count as prose, and how much of an element's text articles beside it may hold.
PROSE = 100
LITTLE = 0.25
#: Share of the clusters' text that the content element holds.
MOST = 0.8
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARTS = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_CLOSES_P = _BLOCKS - {"body", "html", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option", "optgroup", "summary", "figcaption", "title"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


@dataclass
class Line:
    parts: list[tuple[str, bool, int]] = field(default_factory=list)  # text, whether it is linked, its region
    tags: int = 1
    inside: bool = False  # in an article or main element
    heading: bool = False
    element: int = 0  # the innermost block element around it


@dataclass
class Region:
    """An element that may be left out, or an article or main: the ones around it, the share it must hold to stay, its text."""

    around: int
    kind: str = ""  # page, content, comments or named
    share: float = 0.0
    name: str = ""
    size: int = 0


_TAGLIKE = re.compile(r"<[^<>]*>?")
_QUOTED = re.compile(r"""[^"']*(?:"[^"]*"[^"']*|'[^']*'[^"']*)*""")
_ATTRIBUTES = re.compile(r"""<[/!?]*[A-Za-z\[-]*[^\s<>"'=]*(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"?|'[^']*'?|[^\s"'<>]*))*""")


def mended(text: str) -> str:
    """``text`` with every tag whole: unfinished ones go, and quotes that don't pair within a tag."""

    def one(m: re.Match) -> str:
        tag = m[0]
        if not (tag[1:2].isalpha() or tag[1:2] in ("/", "!", "?")):
            return tag
        if tag[-1] != ">":
            return " " + tag[_ATTRIBUTES.match(tag).end() :]
        if tag[1] in "!?":
            return " " + tag[4:-1] if tag[1:4] == "!--" else " "
        return tag if _QUOTED.fullmatch(tag) else tag.replace('"', " ").replace("'", " ")

    return _TAGLIKE.sub(one, text)


class Lines(HTMLParser):
    """Gathers the lines of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.line = Line()
        self.open: list[tuple[str, bool, int]] = []  # tag, whether it is left out, the region around it
        self.at: dict[str, list[int]] = {}  # the places of each tag in it
        self.blocks: list[int] = []  # and of all block elements
        self.elements = [(0, "")]  # of each block element the one around it, and its tag; the first is the page
        self.element = 0
        self.regions = [Region(-1, "page")]
        self.region = 0
        self.out = 0
        self.inside = 0
        self.links = 0

    def _turn(self, tag: str = "") -> None:
        if self.line.parts:
            self.lines.append(self.line)
        self.line = Line(inside=self.inside > 0, heading=tag in _HEADINGS)

    def _push(self, tag: str, out: bool, kind: str, share: float, name: str) -> None:
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in _BLOCKS:
            self.blocks.append(len(self.open))
            self.elements.append((self.element, tag))
            self.element = len(self.elements) - 1
        self.open.append((tag, out, self.region))
        if not self.out:
            for k, s, n in ([(kind, share, name)] if kind else []) + ([("content", 0.0, "")] if tag in ("article", "main") else []):
                self.regions.append(Region(self.region, k, s, n))
                self.region = len(self.regions) - 1
        self.out += out
        self.inside += tag in ("article", "main")
        self.links += tag == "a"

    def _pop(self) -> None:
        tag, out, self.region = self.open.pop()
        self.at[tag].pop()
        if tag in _BLOCKS:
            self.blocks.pop()
            self.element = self.elements[self.element][0]
        self.out -= out
        self.inside -= tag in ("article", "main")
        self.links -= tag == "a"

    def _close(self, tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        """Close up to the innermost open element of ``tags``, if none of ``stops`` lies within it."""
        last = lambda names: max((self.at[t][-1] for t in names if self.at.get(t)), default=-1)
        at = last(tags)
        if at < 0 or at < (self.blocks[-1] if stops is _BLOCKS and self.blocks else last(stops)):
            return
        while len(self.open) > at:
            self._pop()

    def _named(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, str, float, str]:
        """Whether an element is left out at once; else what kind of region it is, the share it must hold to stay and the name that says so."""
        if tag in _NEVER:
            return True, "", 0.0, ""
        found = [(NEARLY_ALL, "")] if tag == "header" and not self.inside else [(HALF, "")] if tag == "form" else []
        silent, kind = self.at.get("pre") or self.at.get("code"), "named"
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
                return True, "", 0.0, ""
            if (name == "aria-hidden" and value == "true") or (name == "role" and value in _ROLES):
                found.append((NEARLY_ALL, ""))
            if name in ("class", "id") and tag not in ("body", "html", "main") and not silent:
                for x in value.split():
                    if share := _share_of_name(x):
                        parts = _HINTS.intersection([x, *_PARTS.findall(x)])
                        if not (tag in _TEXTS and parts <= _WEAK):
                            found.append((share, x))
                            kind = "comments" if parts & _COMMENTS else kind
        return (False, kind, *max(found)) if found else (False, "", 0.0, "")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "button", "object"} | {"article", "section", "div", "li", "blockquote"})
        if tag in _SIBLINGS:
            self._close(_SIBLINGS[tag], _HOLDS[tag])
        if tag == "body":
            self._close({"head"}, set())
        if tag in _BLOCKS:
            self._turn(tag)
        if tag in _VOID:
            if tag == "br" and not self.out:
                self.handle_data(" ")
            self.line.tags += 1
            return
        self._push(tag, *self._named(tag, attrs))
        if tag in _BLOCKS:
            self.line.inside = self.inside > 0
        else:
            self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # browsers take <p/> for <p>

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID:
            return
        if tag in _BLOCKS:
            self._turn()
        else:
            self.line.tags += 1
        if tag == "p":
            self._close({"p"}, {"article", "section", "div", "li", "td", "body"})
        elif tag in ("b", "i", "em", "strong", "span", "a", "u", "small", "font"):
            self._close({tag}, _BLOCKS)
        else:
            self._close({tag}, set())
        if tag in _BLOCKS:
            self.line.inside = self.inside > 0

    def handle_data(self, data: str) -> None:
        if self.out or (not self.line.parts and not data.strip()):
            return
        if not self.line.parts:
            self.line.element = self.element
        self.line.parts.append((data, self.links > 0, self.region))
        self.regions[self.region].size += len(data.strip())

    def parse_html_declaration(self, i: int) -> int:
        """Sections of any name, not only known ones, are passed over."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        end = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        at = self.rawdata.find(end, i)
        return -1 if at < 0 else at + len(end)

    def close(self) -> None:
        """Handle what waits for an end that never comes, once."""
        for _ in range(2):
            rest, self.rawdata = self.rawdata, ""
            if not rest or self.cdata_elem:
                return
            if "<" not in rest:
                self.handle_data(unescape(rest))
                return
            self.feed(mended(rest))
        rest, self.rawdata = self.rawdata, ""
        if rest and not self.cdata_elem:
            self.handle_data(unescape(_TAGLIKE.sub(" ", rest)))

    def kept_regions(self) -> list[bool]:
        """Which regions stay."""
        regions = self.regions
        content, total = [r.kind == "content" for r in regions], sum(r.size for r in regions)
        talk = [False]  # in comments
        for r in regions[1:]:
            talk.append(r.kind == "comments" or talk[r.around])
        if total - sum(r.size for r, t in zip(regions, talk, strict=True) if t) < PROSE:
            talk = [False] * len(regions)
        size = [0 if t else r.size for r, t in zip(regions, talk, strict=True)]
        articles = [0] * len(regions)  # text of articles within
        for i in range(len(regions) - 1, 0, -1):  # inner ones come after those around them
            size[regions[i].around] += size[i]
            articles[regions[i].around] += size[i] if content[i] else articles[i]
        holder, alike = [0], {}  # the nearest content region, or the page; and sizes of its regions of one name
        for i, r in enumerate(regions[1:], 1):
            holder.append(r.around if content[r.around] or not r.around else holder[r.around])
            if r.kind == "named" and not talk[i]:
                key = (holder[i], r.name)
                alike[key] = alike.get(key, 0) + (0 if regions[r.around].name == r.name else size[i])
        kept = [True]
        for i, r in enumerate(regions[1:], 1):
            fine = not talk[i]
            if fine and r.kind in ("named", "comments"):
                h = holder[i]
                share = r.share if content[h] else NEARLY_ALL
                own = size[i] >= r.share * size[h] or (articles[i] == articles[h] > 0 and articles[h] >= r.share * size[h])
                fine = articles[h] - articles[i] <= LITTLE * size[i] and own or (r.name != "" and alike.get((h, r.name), 0) >= share * size[h] and articles[h] - articles[i] <= LITTLE * alike[(h, r.name)])
            kept.append(kept[r.around] and fine)
        return kept

    def finish(self) -> list[tuple[Line, str, int]]:
        """The lines that hold text of regions that stay, with that text and how much of it is linked."""
        self.close()
        self._turn()
        kept, out = self.kept_regions(), []
        for line in self.lines:
            parts = [p for p in line.parts if kept[p[2]]]
            if text := _SPACE.sub(" ", "".join(p[0] for p in parts)).strip():
                out.append((line, text, sum(len(p[0]) for p in parts if p[1])))
        return out

    def content_element(self, element: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Which of the lines, given by their ``element``, stand in the innermost element that holds MOST of the ``weight``; where
        that is the whole body, which are texts beside those of weight."""
        held = np.bincount(element, weight, minlength=len(self.elements))
        around = [a for a, _ in self.elements]
        for i in range(len(held) - 1, 0, -1):
            held[around[i]] += held[i]
        best = 0
        for i in range(1, len(held)):  # elements come after those around them
            if around[i] == best and held[i] >= MOST * held[0]:
                best = i
        if self.elements[best][1] in ("", "html", "body"):
            outer = np.array(around)[element]
            return np.isin(outer, outer[weight > 0]) & np.array([self.elements[e][1] in _SIBLING_TEXTS for e in element])
        within = np.zeros(len(held), bool)
        within[best] = True
        for i in range(best + 1, len(held)):
            within[i] = within[around[i]]
        return within[element]


def _share_of_name(name: str) -> float:
    """What a class or id says: see ``NEARLY_ALL`` and ``HALF``; 0 if nothing."""
    parts = _PARTS.findall(name)
    if name in _HINTS or (_HINTS.intersection(parts) and all(p in _HINTS or p in _HOLDERS or p[0].isdigit() for p in parts)):
        return NEARLY_ALL
    return HALF if parts and parts[-1] in _HINTS and not _STATES.intersection(parts) else 0.0


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return total / weight


def main_text(html: str | None) -> str:
    """The main text of a page: blocks joined by two line feeds."""
    parser = Lines()
    parser.feed(html or "")
    found = parser.finish()
    kept = [(line, text) for line, text, _ in found]
    if not kept:
        return ""
    ratios = np.array([len(text) / line.tags for line, text in kept])
    near, least = smoothed(ratios), SHARE * ratios.std()
    linked = np.array([n > LINKED * len(text) for _, text, n in found])
    heading = np.array([line.heading for line, _ in kept])
    inside = np.array([line.inside for line, _ in kept])
    size = np.array([len(text) for _, text in kept]) * ((near >= least) & ~linked)
    element = np.array([line.element for line, _ in kept])
    bound = np.ones(len(kept), bool)
    if inside.any() and size[inside].sum() >= BOUND * size.sum():
        bound, least = inside, min(least, SHARE * np.exp(np.log(ratios[inside]).mean()))
        items = np.array([parser.elements[e][1] == "li" for e in element]) & (np.cumsum(size) > 0)
        linked &= (ratios < least) & ~heading & ~items
    at = np.flatnonzero((near >= least) & ~linked & bound)
    if not len(at):
        return "\n\n".join(text for (_, text), r in zip(kept, bound, strict=True) if r)
    first, last = at[0], at[-1]
    if bound is inside:
        beside = np.flatnonzero(bound & ~linked)
        k, n = np.searchsorted(beside, (first, last))
        first, last = beside[max(0, k - int(SIGMA))], beside[min(len(beside) - 1, n + int(SIGMA))]
    scope = bound if bound is inside else parser.content_element(element, size)
    plain = np.flatnonzero(scope & ~linked & np.array([line.tags == 1 for line, _ in kept]))
    if len(plain):
        first, last = min(first, plain[0]), max(last, plain[-1])
    while first and heading[first - 1] and bound[first - 1]:
        first -= 1
    region = np.zeros(len(kept), bool)
    region[first : last + 1] = True
    region &= bound & ~linked
    return "\n\n".join(text for (_, text), r in zip(kept, region, strict=True) if r)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    small_batches(pages.sparkSession)
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=fields)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))

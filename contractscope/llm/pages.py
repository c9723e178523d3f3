"""Main text of web pages from parser events: text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: HTML element names by their part in a page's layout.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
SILENT = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "option", "button", "textarea", "input", "label", "datalist"}
LAYOUT = {"nav", "footer", "aside", "form", "menu", "dialog", "search"}
MAIN = {"article", "main"}
#: Elements that leave an open head open; all others, and text, end it.
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: What bounds the search for an open element that a start tag ends by implication.
SCOPE = {"html", "table", "td", "th", "caption", "template", "object", "svg", "math", "button", "marquee"}
ENDS_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_ITEM = (BLOCK | SCOPE) - {"address", "div", "p"}
_ROW = {"tr", "td", "th", "caption", "colgroup"}
_ROWS = _ROW | {"tbody", "thead", "tfoot"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Start tags: the open elements that they end, and the elements that bound the search.
IMPLIED = {
    "li": ({"li"}, _ITEM), "dd": ({"dd", "dt"}, _ITEM), "dt": ({"dd", "dt"}, _ITEM),
    "option": ({"option"}, SCOPE | {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, SCOPE | {"select"}),
    "select": ({"select"}, SCOPE), "input": ({"select"}, SCOPE), "textarea": ({"select"}, SCOPE), "button": ({"button"}, SCOPE - {"button"}),
    "td": ({"td", "th"}, {"table", "template"}), "th": ({"td", "th"}, {"table", "template"}), "tr": (_ROW, {"table", "template"}),
    **{x: (_ROWS, {"table", "template"}) for x in ("tbody", "thead", "tfoot", "caption", "colgroup")},
}
#: Words that name, in class, id, role and the like, what is no article text; and words of layout that may stand beside them.
CHROME = set("ad ads advert adverts advertisement advertisements advertising adsense adslot adunit mpu dfp leaderboard skyscraper taboola outbrain sponsor sponsored sponsors sponsorship promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices popup modal newsletter subscribe sidebar menu menus navbar nav navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond replies share sharing social related widget widgets toolbar pagination pager skiplink complementary contentinfo header".split())
BESIDE = set("a the site page main global top bottom left right upper lower inner outer primary secondary sub article articles post posts entry blog content story news list lists item items box bar bars area block section container wrapper wrap panel row col column grid group links link buttons button icons icon widget media tools count form thread sticky fixed mobile desktop small large big new more js is has t u l c v1 v2 v3 side skip to by us this text body slot unit 1 2 3 4 5 6 7 8 9".split())
#: Attributes whose value names an element's part.
NAMING = ("class", "id", "role", "data-component", "data-testid", "data-module", "data-widget", "data-region")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LEGAL = re.compile(r"\s*(?:\u00a9|\(c\)|copyright\b|all rights reserved)", re.I)


def names_chrome(value: str, header_too: bool = True) -> bool:
    """Whether a name among several is a word of CHROME with nothing but layout words beside it.

    So comment-list, siteFooter and ad_slot_2 are, but market-share, related-work and social-policy say what a text is about.
    """
    for name in value.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        chrome = [x for x in parts if x in CHROME and (header_too or x != "header")]
        if chrome and all(x in CHROME or x in BESIDE for x in parts):
            return True
    return False


@dataclass
class Line:
    """One block's text; tags is the number of tags met since the line before."""

    text: str
    tags: int
    links: int
    root: int
    silent: bool


@dataclass
class Reader(HTMLParser):
    """Cuts parser events into lines at block elements and keeps which layout part each line is in."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []
        self.soft = 0  # depth of the outermost element whose name says header: its h1 is the page's title
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.tags = self.linked = self.roots = 0

    def _state(self) -> tuple[bool, int]:
        return (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, 0)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            silent, root = self._state()
            self.lines.append(Line(text, self.tags, self.linked, root, silent))
            self.tags = self.linked = 0
        self.parts = []

    def _end(self, ended: set[str], bounds: set[str]) -> None:
        """Take the outermost open one of the ended elements, and all in it, off the stack."""
        found = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in ended:
                found = i
            elif self.stack[i][0] in bounds:
                break
        if found is not None:
            self._cut(found)

    def _cut(self, i: int) -> None:
        for tag, _, _ in self.stack[i:]:
            self.open[tag] -= 1
        del self.stack[i:]
        if len(self.stack) < self.soft:
            self.soft = 0

    def _imply(self, tag: str) -> None:
        """End what a start tag ends without an end tag, by HTML's rules; elements that need an end tag stay open."""
        if tag == "body" or (tag not in IN_HEAD and self.stack and self.stack[-1][0] == "head"):
            self._end({"head"}, {"body", "template"})
        if tag in IMPLIED and any(map(self.open.get, IMPLIED[tag][0])):
            self._end(*IMPLIED[tag])
        if tag in ENDS_P:
            if self.open.get("p"):
                self._end({"p"}, SCOPE)
        if tag in _HEADING and self.stack and self.stack[-1][0] in _HEADING:
            self._cut(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
        elif tag == "br":
            self.parts.append(" ")
        self._imply(tag)
        self.tags += 1
        if tag in VOID:
            return
        silent, root = self._state()
        if tag == "h1" and self.soft and silent:
            silent = False
        names = " ".join(v for k, v in attrs if k in NAMING and v)
        if tag in SILENT or tag in LAYOUT or (tag == "header" and not root):
            silent = True
        elif names and tag not in {"html", "body"} and (root or tag not in MAIN):
            if names_chrome(names, False):
                silent = True
            elif not root and names_chrome(names):
                self.soft = self.soft if silent else len(self.stack) + 1
                silent = True
        if any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and _HIDDEN.search(v)) for k, v in attrs):
            silent = True
        if tag in MAIN and not silent and not root:
            self.roots += 1
            root = self.roots
        self.stack.append((tag, silent, root))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        self.tags += 1
        if not self.open.get(tag):
            return
        i = len(self.stack) - 1
        while self.stack[i][0] != tag:
            i -= 1
        self._cut(i)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._cut(len(self.stack) - 1)
        if not self._state()[0]:
            self.parts.append(data)
            if self.open.get("a"):
                self.linked += len(data.strip())
        elif self.parts and self.parts[-1] != " ":
            self.parts.append(" ")

    def finish(self) -> list[Line]:
        self.close()
        self._flush()
        return self.lines


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with mirrored ends."""
    r = max(1, int(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="symmetric"), w / w.sum(), mode="valid")


def select(lines: list[Line], sigma: float = 1.0, share: float = 0.2) -> list[str]:
    """Texts of the lines in the content regions, in page order.

    Each line's ratio is its characters outside links over its tags. Smoothed ratios of at least `share` of their
    standard deviation mark content regions, the others gaps. Outside of article and main elements the lines of the
    content regions are taken. An article or main element that has a content region counts as one, gaps and all, as its
    short lines belong to it; but not a gap that is mostly links, such as a list of other articles.
    """
    kept = [x for x in lines if not x.silent]
    if not kept:
        return []
    ratio = np.array([max(0, len(x.text) - x.links) / max(1, x.tags) for x in kept])
    even = smooth(ratio, sigma)
    marked = even >= share * even.std()
    roots = {x.root for x, hit in zip(kept, marked, strict=True) if hit and x.root}
    if not roots:
        last = len(kept) - 3
        return [x.text for i, (x, hit) in enumerate(zip(kept, marked, strict=True)) if hit and x.links <= len(x.text) / 2 and not (i >= last and len(x.text) < 200 and _LEGAL.match(x.text))]
    starts = np.flatnonzero(np.concatenate([[True], (marked[1:] != marked[:-1]) | np.array([x.root != y.root for x, y in zip(kept, kept[1:])], bool)]))
    out: list[str] = []
    for a, b in zip(starts, [*starts[1:], len(kept)], strict=True):
        some = kept[a:b]
        if some[0].root in roots and (marked[a] or 2 * sum(x.links for x in some) <= sum(len(x.text) for x in some)):
            out += [x.text for x in some]
    return out


_OPENS = re.compile(r"<!--|<(script|style)\b", re.I)
_CLOSES = {x: re.compile(f"</{x}", re.I) for x in ("script", "style")}


def unclosed_cut(html: str) -> str:
    """The page up to a comment that nothing closes, which runs to its end; inside a script or style it is no comment."""
    last = html.rfind("-->") + 1
    if html.find("<!--", last) < 0:
        return html
    at = 0
    while (m := _OPENS.search(html, at)) is not None:
        if m[1]:
            closed = _CLOSES[m[1].lower()].search(html, m.end())
            if closed is None:
                return html
            at = closed.end()
        elif m.start() >= last:
            return html[: m.start()]
        else:
            at = html.index("-->", m.start() + 2) + 3
    return html


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.2) -> str:
    """Main text of a page; empty for a null or empty page or one without any content region."""
    reader = Reader()
    reader.feed(unclosed_cut(html or ""))
    return "\n\n".join(select(reader.finish(), sigma, share))


def extract(df: DataFrame, key: str = "page_id", sigma: float = 1.0, share: float = 0.2) -> DataFrame:
    """(key, url, text, n_chars) for every page, from its whole html.

    A narrow job: pages are never shuffled, and a page's size is bounded by its own row only. Null and empty html
    gives an empty text. Broken markup never fails. Repeated rows are kept; other columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, sigma, share) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[key, "url", "text", "n_chars"])

    return df.select(key, "url", "html").mapInArrow(run, f"{key} {kind}, url string, text string, n_chars long")

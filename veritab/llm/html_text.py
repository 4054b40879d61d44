"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page's events into lines, one for each block of text. Every line has
a ratio of its characters to the tags in it; the ratios are smoothed with a Gaussian and split into two
clusters by a threshold. The lines of the upper cluster mark the content region, which is then taken whole: the
article or main element that holds most of the marked text, or else the stretch from the first marked line to the last,
what else lies in the same containers, and the lines before and behind up to one that is mostly links. Elements that only their name, a form or an attribute tells to be no content are
dropped after the whole page is read, and kept if they hold its landmark or most of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veritab.llm.common import ROWS

#: Elements that end a block of text, and elements without an end tag.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td "
                   "tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never content, and the words that as class, id or role tell the same of an element that has not the page's
#: text in it; so do names that end in such a word, places left off, but for those with a word of HOLDS: "has-sidebar" has one.
OUTSIDE = frozenset("head nav footer aside script style noscript template button select option textarea iframe svg math "
                    "object audio video canvas dialog menu title".split())
OUTSIDE_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
                          "footer menu nav navbar navigation newsletter notice notices pagination popup promo promoted reader-comments "
                          "related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary "
                          "contentinfo search alert".split())
HOLDS = frozenset("has have no not non with without hide show free".split())
PLACES = frozenset("area bar block bottom box container inner item items left links list middle outer panel right section slot top "
                   "unit wrap wrapper".split())
#: Words for what readers add, which may be more than the page's own text.
READERS = frozenset("comment comments disqus reader-comments respond".split())
LANDMARKS = frozenset(("article", "main"))
CONTAINERS = frozenset("article blockquote body center div main section td".split())
#: Elements that a start tag of the key closes when they are still open.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}


class Lines(HTMLParser):
    """Collects (text, tags, landmark, container, doubt, linked) of each block, with the numbers of the article or main element,
    of the container and of the doubtful element around it, 0: none, and the characters in links. ``doubts`` has of each doubtful element the one around it
    and why it is one: form, name, readers or hidden."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, int]] = []
        self.open: list[tuple[str, bool, int, int, int]] = []  # tag, can it be content, landmark, container, doubt
        self.places: dict[str, list[int]] = {}  # where each tag is open
        # Open blocks, and open blocks and elements of no content, up to each place; so that no tag has to look through all that is open.
        self.blocks: list[int] = [0]
        self.walls: list[int] = [0]
        self.linked = 0
        self.doubts: list[tuple[int, str]] = [(0, "")]
        self.text: list[str] = []
        self.tags = 0
        self.landmarks = self.containers = 0

    def inside(self) -> tuple[bool, int, int, int]:
        return self.open[-1][1:] if self.open else (True, 0, 0, 0)

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, *self.inside()[1:], self.linked))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for other in CLOSES.get(tag, ()):
            if self.open and self.open[-1][0] == other or self.closable(other):
                self.handle_endtag(other)
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        content, landmark, container, doubt = self.inside()
        if content and (tag in OUTSIDE or tag == "header" and not landmark):
            self.end_line()
            content = False
        why = self.doubtful(tag, attrs) if content else ""
        if why:
            self.end_line()
            self.doubts.append((doubt, why))
            doubt = len(self.doubts) - 1
        if content and tag in LANDMARKS and not landmark:
            self.landmarks += 1
            landmark = self.landmarks
        if tag in CONTAINERS:
            self.containers += 1
            container = self.containers
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, content, landmark, container, doubt))
        self.blocks.append(self.blocks[-1] + (tag in BLOCKS))
        self.walls.append(self.walls[-1] + (tag in BLOCKS or tag in OUTSIDE))

    def closable(self, tag: str) -> bool:
        """Is ``tag`` open with only inline elements inside it?"""
        return bool(self.places.get(tag)) and self.walls[-1] == self.walls[self.places[tag][-1] + 1]

    @staticmethod
    def doubtful(tag: str, attrs: list) -> str:
        """Why an element may be no content; empty if nothing tells so."""
        if tag in ("html", "body", "main", "article"):
            return ""
        why = "form" if tag == "form" else ""
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return "hidden"
            if value and name == "style" and "display:none" in value.replace(" ", "").lower():
                return "hidden"
            if value and name in ("class", "id", "role"):
                for w in value.lower().replace("_", "-").split():
                    parts = [p for p in w.split("-") if p]
                    while len(parts) > 1 and parts[-1] in PLACES:
                        parts.pop()
                    if w in OUTSIDE_WORDS or parts and parts[-1] in OUTSIDE_WORDS and HOLDS.isdisjoint(parts):
                        why = "readers" if w in READERS or parts[-1] in READERS else why or "name"
        return why

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = self.places[tag][-1] if self.places.get(tag) else -1
        self.tags += 1
        blocks = self.blocks[-1] - self.blocks[at] if at >= 0 else 0
        if tag in BLOCKS or at >= 0 and (blocks or self.open[at][1] != (at == 0 or self.open[at - 1][1])
                                         or self.open[at][4] != (at and self.open[at - 1][4])):
            self.end_line()
        if at >= 0 and (tag in BLOCKS or tag in OUTSIDE or not blocks):
            for name, *_ in self.open[at:]:
                self.places[name].pop()
            del self.open[at:], self.blocks[at + 1:], self.walls[at + 1:]

    def handle_data(self, data: str) -> None:
        if self.inside()[0]:
            self.text.append(data)
            if self.places.get("a"):
                self.linked += len("".join(data.split()))


def lines_of(html: str) -> list[tuple[str, int, int, int, int, int]]:
    """Lines that may be content; in place of the doubtful element around each stands the number of them."""
    parser = Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # the parser gives up on some marked sections; as text they do no harm
        parser = Lines()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    parser.end_line()
    if len(parser.doubts) == 1:
        return parser.lines
    depth, dropped = judged(parser.lines, parser.doubts)
    out, tags = [], 0
    for text, own, landmark, container, doubt, linked in parser.lines:
        tags += own  # those of dropped lines count for the next one
        if not dropped[doubt]:
            out.append((text, tags, landmark, container, depth[doubt], linked))
            tags = 0
    return out


def judged(lines: list[tuple[str, int, int, int, int, int]], doubts: list[tuple[int, str]]) -> tuple[list[int], list[bool]]:
    """How deep each doubtful element lies in others, itself included, and whether it is dropped.

    One is kept that holds the page's landmark: of those in the fewest doubtful elements the one with most text, if that is
    more than the text in no doubtful element. One is also kept that holds more than half of the text; but for a
    form, no landmark may then stand outside of it. What readers add and what is hidden is kept only for a landmark with more than
    half of the page's text. What lies in a dropped element is dropped.
    """
    depth, size = [0] * len(doubts), [0] * len(doubts)
    for d in range(1, len(doubts)):
        depth[d] = depth[doubts[d][0]] + 1
    marks: dict[int, list[int]] = {}  # landmark: depth, characters, doubtful element around it
    plain = 0
    for text, _, landmark, _, doubt, _ in lines:
        size[doubt] += len(text)
        plain += len(text) * (not doubt)
        if landmark:
            mark = marks.setdefault(landmark, [depth[doubt], 0, doubt])
            mark[1] += len(text)
            if depth[doubt] < mark[0]:
                mark[0], mark[2] = depth[doubt], doubt
    for d in range(len(doubts) - 1, 0, -1):
        size[doubts[d][0]] += size[d]
    total = size[0]
    least = min((m[0] for m in marks.values()), default=0)
    first = max((m for m in marks.values() if m[0] == least), key=lambda m: m[1], default=None)
    holds = set()
    at = first[2] if first and first[1] > plain else 0
    while at:
        holds.add(at)
        at = doubts[at][0]
    dropped = [False] * len(doubts)
    for d in range(1, len(doubts)):
        around, why = doubts[d]
        if why in ("readers", "hidden"):
            kept = d in holds and 2 * first[1] > total
        else:
            kept = d in holds or 2 * size[d] > total and (why == "form" or not first or first[0] >= depth[d])
        dropped[d] = dropped[around] or not kept
    return depth, dropped


def smoothed(ratios: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach:reach + len(ratios)] / weight


def cluster_threshold(values: np.ndarray) -> float:
    """Border between the two clusters of values, found by moving it between their means."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        border = (low + high) / 2
        below, above = values[values < border], values[values >= border]
        if not len(below):
            return low
        now = float(below.mean()), float(above.mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """Blocks of the content region, in page order, with an empty line between them."""
    lines = lines_of(html or "")
    if not lines:
        return ""
    length = np.array([len(line[0]) for line in lines], float)
    marked = smoothed(length / np.array([max(1, line[1]) for line in lines]))
    marked = marked >= cluster_threshold(marked)
    landmark, container = np.array([line[2] for line in lines]), np.array([line[3] for line in lines])
    share = np.bincount(landmark, weights=length * marked)
    depth = np.full(len(share), len(lines))
    np.minimum.at(depth, landmark, [line[4] for line in lines])
    # An element made for content goes before what lies around it, and before one in more doubtful elements.
    best = min((b for b in range(1, len(share)) if share[b] > 0), key=lambda b: (depth[b], -share[b]), default=0)
    if best:
        chosen = np.flatnonzero(landmark == best)
    else:
        # Links alone mark nothing, unless there is nothing else.
        links = np.array([2 * line[5] > len("".join(line[0].split())) for line in lines])
        at = np.flatnonzero(marked & ~links) if (marked & ~links).any() else np.flatnonzero(marked)
        first, last = int(at[0]), int(at[-1])
        # A region has no inner border at a short line, and none outside but a line of links.
        while first > 0 and not links[first - 1]:
            first -= 1
        while last + 1 < len(lines) and not links[last + 1]:
            last += 1
        chosen = np.union1d(np.arange(first, last + 1), np.flatnonzero(np.isin(container, container[at]) & (container > 0)))
    return "\n\n".join(lines[i][0] for i in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages``.

    Null and empty pages, and pages without content, have an empty text. Pages are worked on one by one, so
    repeated rows give equal results; an empty table gives no rows. Columns other than page_id, url and html are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars long")

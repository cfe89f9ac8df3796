"""Main text of web pages by line-block distribution.

Markup is stripped to lines: a line is the text between two block tags or line breaks. Each line has a weight:

* its characters without those in links, less the latter once more: a line of links weighs less than nothing;
* times a small factor for its tag: BARE, in a paragraph, heading or list item PROSE, in article or main AREA, where links count as text;
* a bare line, which no tag speaks for, pays a toll: a TOLL-th of the page's level. The level is the length of the line that a character of the page's unlinked text
  lies in on average, so a notice between long paragraphs weighs less than nothing, and a verse among verses does not.

The weights are summed over a sliding window of WINDOW lines. A surge is a place where the sum rises above nothing and reaches SURGE before it
falls again (or the page's greatest sum, where that is less); the dive is where it has fallen to nothing. The text from the surge's first line that weighs more than nothing to the dive's last
one is a region, light lines between them included, and so are paragraphs of links directly before or after it, if fewer than WINDOW follow each
other. A window that never reaches SURGE begins no region: a lone short line, a copyright notice or a list of links.

Some parts are markup and stripped with it: scripts, styles, and what is no reading matter by its tag or by the name of its class, id or role (menus, headers, footers,
sidebars, notices, adverts, forms, comments of readers). Outside article and main no window looks over the place where one was, nor over the borders of article and
main. A part told by its name alone stays if it holds all of the page's article and main parts, or three quarters of their text (without any, of the page's);
in an article that does not hold for readers' comments. In an article's header headings and paragraphs count, and an article inside another whose name
says so is a comment. The side with the greater weight, the regions in article and main or those outside, shows where the page's text is: if article and main
weigh more, nothing outside is kept, else all regions are. So a page without either is judged by its blocks alone, and an article tag around a teaser does
not hide the text beside it. Where all these tags and names are made plain, the windows find the same text: tests/llm says how nearly.

Character references are decoded after the tags are gone; white space in a line becomes one blank; lines are joined by one blank in the
order of the page. Null or empty html, and a page without any region, give an empty text. Unclosed tags end with the page or with
the part around them; a quote left open ends with its tag. Repeated rows give repeated rows, a null page_id or url stays null; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
BARE, PROSE, AREA = 1, 4, 8
SURGE = 40
TOLL = 3
#: Elements whose text is never shown as text.
SILENT = {"template", "svg", "head", "iframe", "object", "canvas", "math", "audio", "video"}
#: Those whose inside is no markup.
RAW = {"script", "style", "textarea", "title", "noscript"}
#: Elements with text that is no reading matter.
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "option"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = HEADINGS | {"p", "blockquote"}
PROSAIC = PARAGRAPHS | {"li", "dt", "dd", "pre", "figcaption", "td", "th"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that a new one of their kind closes, and what they lie in.
CLOSED_BY_NEXT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SIBLINGS = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words that name such a part where they end a class, id or role, whatever stands before them.
STRONG = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "promo", "promotion", "sponsor", "sponsored", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "comment", "comments", "reply", "replies", "disqus", "cookie", "cookies", "consent", "newsletter", "share", "sharing", "social", "related", "recommended", "popup", "modal", "toolbar",
    "complementary", "contentinfo", "alertdialog",
}
#: Words that do where the whole name is made of such words.
WEAK = {"header", "masthead", "side", "banner", "respond", "notice", "notices", "alert", "subscribe", "signup", "login", "search", "widget", "widgets", "copyright", "dialog", "form", "forms"}
#: Words that say nothing about a part.
NEUTRAL = {"site", "page", "top", "bottom", "left", "right", "box", "block", "area", "container", "wrapper", "wrap", "list", "item", "items", "section", "bar", "inner", "outer", "row", "col", "column", "links", "link", "slot", "unit", "zone", "group", "panel", "global", "primary", "secondary", "main", "js", "posts", "body", "buttons", "icons", "thread"}
#: Names of readers' comments.
READERS = {"comment", "comments", "reply", "replies", "disqus"}
#: Words after which a name speaks of a part elsewhere.
ELSEWHERE = {"has", "with", "no", "without", "is", "not"}
_VALUE = r"(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^\s\"'<>]+)"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s+|/|[^\s\"'<>/=]+(?:\s*=\s*" + _VALUE + r")?)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|(?=<)|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLANKS = re.compile(r"\s+")
_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I) for tag in RAW}


def names_aside(name: str) -> bool:
    """Whether one class, id or role names a part that is no reading matter."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and words[-1] in NEUTRAL:
        words.pop()
    if not words or ELSEWHERE & set(words):
        return False
    return words[-1] in STRONG or words[-1] in WEAK and all(w in STRONG or w in WEAK or w in NEUTRAL for w in words)


def marked(attributes: str) -> bool:
    return any(names_aside(name) for m in _NAMES.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split())


@dataclass
class Line:
    """text "": a wall. linked: characters in links. paragraph: of PARAGRAPHS. named: parts around it that are told by name alone, by number."""

    text: str
    linked: int = 0
    prose: bool = False
    paragraph: bool = False
    inside: bool = False
    named: tuple[int, ...] = ()


@dataclass
class Part:
    """An open block element."""

    tag: str
    silent: bool = False  # a wall by its tag
    area: bool = False
    named: int = -1  # its number, if it is told by its name
    heads: bool = False  # an article's header: stripped, but for its headings and paragraphs


class Lines:
    """One pass over a page."""

    def __init__(self) -> None:
        self.out: list[Line] = []
        self.stack: list[Part] = []
        self.held: list[str] = []
        self.linked = self.muted = self.inside = self.prose = self.heads = self.paragraphs = 0
        self.link_depth = -1  # depth of the stack where the open link began
        self.asides: list[tuple[str, int]] = []  # inline elements that are no reading matter, and the stack's depth there
        self.named: list[int] = []
        self.n_named = 0
        self.n_areas = 0
        self.areas_in: dict[int, int] = {}
        self.readers: set[int] = set()

    def flush(self) -> None:
        if self.held:
            line = _BLANKS.sub(" ", html.unescape("".join(self.held))).strip()
            if line:
                self.out.append(Line(line, min(self.linked, len(line)), self.prose > 0, self.paragraphs > 0, self.inside > 0, tuple(self.named)))
            self.held.clear()
        self.linked = 0

    def wall(self) -> None:
        self.out.append(Line("", inside=self.inside > 0, named=tuple(self.named)))

    def say(self, text: str) -> None:
        if text and not self.muted and not self.asides and (self.paragraphs or not self.heads):
            self.held.append(text)
            if self.link_depth >= 0:
                self.linked += len(_BLANKS.sub(" ", html.unescape(text)).strip())

    def push(self, part: Part) -> None:
        self.around(part)
        self.stack.append(part)
        self.count(part, 1)
        if part.named >= 0:
            self.named.append(part.named)
        if part.area:
            self.n_areas += 1
            for k in self.named:
                self.areas_in[k] = self.areas_in.get(k, 0) + 1

    def around(self, part: Part) -> None:
        if part.silent or part.area or part.heads or part.named >= 0:
            self.wall()

    def count(self, part: Part, by: int) -> None:
        self.muted += by * part.silent
        self.inside += by * part.area
        self.heads += by * part.heads
        self.prose += by * (part.tag in PROSAIC)
        self.paragraphs += by * (part.tag in PARAGRAPHS)

    def pop(self) -> None:
        part = self.stack.pop()
        self.count(part, -1)
        if part.named >= 0:
            self.named.pop()
        self.around(part)
        if self.link_depth > len(self.stack):
            self.link_depth = -1
        while self.asides and self.asides[-1][1] > len(self.stack):
            self.asides.pop()

    def close(self, tag: str) -> None:
        if any(p.tag == tag for p in self.stack):
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()

    def open(self, tag: str, attributes: str) -> None:
        if self.stack and self.stack[-1].tag == "p":  # no block lies in a paragraph
            self.pop()
        around = CLOSED_BY_NEXT.get(tag, ())
        for k in range(len(self.stack) - 1, -1, -1):
            if not around or self.stack[k].tag in around:
                break
            if self.stack[k].tag in SIBLINGS.get(tag, {tag}):
                while len(self.stack) > k:
                    self.pop()
                break
        heads = tag == "header" and any(p.tag == "article" for p in self.stack)
        silent = not heads and (tag in SILENT or tag in ASIDE)
        area = tag in ("article", "main") and not self.muted and not (self.inside and marked(attributes))
        named = -1
        if not silent and not area and not heads and tag not in ("body", "html") and marked(attributes):
            named, self.n_named = self.n_named, self.n_named + 1
            if READERS & {w.lower() for m in _NAMES.finditer(attributes) for w in _WORDS.findall(m[0])}:
                self.readers.add(named)
        self.push(Part(tag, silent, area, named, heads))


def lines_of(page: str) -> list[Line]:
    p, at = Lines(), 0
    while True:
        m = _TAG.search(page, at)
        if not m:
            p.say(page[at:])
            break
        p.say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag == "a":
                p.link_depth = -1
            elif p.asides and p.asides[-1][0] == tag:
                p.asides.pop()
            elif tag not in INLINE:
                p.flush()
                p.close(tag)
            continue
        if tag in RAW:
            p.flush()
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag in INLINE:
            if tag == "a":
                p.link_depth = len(p.stack)
            elif p.asides and p.asides[-1][0] == tag or tag not in VOID and marked(attributes):
                p.asides.append((tag, len(p.stack)))
        else:
            p.flush()
            if tag not in VOID and not attributes.endswith("/"):
                p.open(tag, attributes)
    p.flush()
    return without_named(p)


def without_named(p: Lines) -> list[Line]:
    """Lines in parts that are told by name become walls, but for parts that hold all article and main parts or most of the text."""
    if not p.n_named:
        return p.out
    plain = [max(0, len(x.text) - x.linked) if x.inside or not p.n_areas else 0 for x in p.out]
    own = np.zeros(p.n_named, int)
    for x, n in zip(p.out, plain, strict=True):
        for k in x.named:
            own[k] += n
    most = {k for k in range(p.n_named) if 4 * own[k] >= 3 * sum(plain) and not (p.n_areas and k in p.readers)}
    asides = {k for k in range(p.n_named) if k not in most and not 0 < p.n_areas == p.areas_in.get(k, 0)}
    return [Line("", inside=x.inside) if asides.intersection(x.named) else x for x in p.out]


def weights_of(lines: list[Line]) -> list[float]:
    """Walls weigh nothing."""
    sizes = np.array([len(x.text) - x.linked for x in lines])
    toll = (sizes**2).sum() / max(1, sizes.sum()) / TOLL

    def weight(line: Line) -> float:
        if line.inside:
            return AREA * len(line.text)
        n = len(line.text) - 2 * line.linked
        return PROSE * n if line.prose else BARE * n - toll

    return [weight(x) if x.text else 0 for x in lines]


def regions(weights: list[int], walls: list[bool], window: int = WINDOW) -> list[tuple[int, int]]:
    """Places of the first and after the last line of each region."""
    edges = [-1, *np.flatnonzero(walls).tolist(), len(walls)]
    # for each run of lines between walls, sums[k]: of the window that ends in line k; it may begin before the first line and end after the last
    runs = [(a + 1, np.array(weights[a + 1 : b])) for a, b in zip(edges, edges[1:], strict=False) if b > a + 1]
    summed = [(a, own, np.convolve(own, np.ones(window, int))) for a, own in runs]
    enough = min([SURGE, max((int(s.max()) for _, _, s in summed), default=0)])
    out = []
    for a, own, sums in summed:
        up, done = np.concatenate([[False], sums > 0, [False]]), 0
        for surge, dive in zip(np.flatnonzero(up[1:] & ~up[:-1]), np.flatnonzero(~up[1:] & up[:-1]), strict=True):
            if sums[surge:dive].max() < enough:
                continue
            first = max(done, surge - window + 1)
            heavy = first + np.flatnonzero(own[first:dive] > 0)
            if len(heavy):
                done = int(heavy[-1]) + 1
                out.append((a + int(heavy[0]), a + done))
    return out


def with_links(lines: list[Line], found: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """The regions, with paragraphs of links directly before and after, fewer than the window's lines."""
    links = [x.text != "" and not x.inside and x.linked == len(x.text) for x in lines]
    out = []
    for k, (a, b) in enumerate(found):
        low, high = out[-1][1] if out else 0, found[k + 1][0] if k + 1 < len(found) else len(lines)
        before, after = a, b
        while before > low and links[before - 1]:
            before -= 1
        while after < high and links[after]:
            after += 1
        out.append((before if a - before < window and all(x.paragraph for x in lines[before:a]) else a, after if after - b < window and all(x.paragraph for x in lines[b:after]) else b))
    return out


def main_lines(lines: list[Line], window: int = WINDOW) -> list[str]:
    lines = [x for x in lines if x.text or not x.inside]  # in article and main windows look over what was stripped
    weights = weights_of(lines)
    found = regions(weights, [not x.text for x in lines], window)
    mass = {True: 0, False: 0}
    for a, b in found:
        mass[lines[a].inside] += sum(weights[a:b])
    return [lines[k].text for a, b in with_links(lines, found, window) if lines[a].inside or mass[False] > mass[True] for k in range(a, b)]


def extract(page: str) -> str:
    return " ".join(main_lines(lines_of(page)))


def extract_text(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")

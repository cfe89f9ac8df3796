"""Main text of pages: the method against a plain version of itself, and pages by hand."""

import html
import random
import re
from collections import Counter

import duckdb
import pytest

from tidepool.llm import html_text as h

LONG = "Long text of the page that goes on and on, with many words."
PAGES = {
    "letters whose lower case is longer": ("İ" * 12 + "<script>x</script><p>first words</p><p>second</p>", "İ" * 12 + " first words second"),
    "a title in a part named header": ('<article><div class="article-header"><h1>Title</h1></div><p>x y</p></article>', "Title x y"),
    "a name with a mark in front": ('<article><section class="search-results-analysis"><p>Kept text</p></section></article>', "Kept text"),
    "links at an article's end": ("<article><p>text</p><p><a href=x>last words</a></p><ul><li><a href=y>one</a><li><a href=y>two</a></ul></article>", "text last words one two"),
    "a quote left open": ('<p>Some text that is long enough <a href="x>oops</a> and more</p>', "Some text that is long enough oops and more"),
    "an angle bracket in a value": ('<p><a title="a > b" href=x?y=z>link</a> and enough text beside it</p>', "link and enough text beside it"),
    "a sidebar by name, a page that has one": ('<div class="page has-sidebar"><article><p>a b</p><div id=sidebar>no</div><p>c</article></div>', "a b c"),
    "comments as articles": ('<article><p>a b</p><article class="comment-body">hi there</article></article><div class=comments><article>more</article></div>', "a b"),
    "an article's own header": ("<header>Site</header><article><header><h1>Own title</h1><div>by me</div></header><p>Text.</p></article>", "Own title Text."),
    "short pieces between adverts": ("<main><p>One.</p><div class=ad>Buy</div><p>Er.</p><aside>Side</aside>two</main><p>not in it</p>", "One. Er. two"),
    "a teaser in an article beside the text": ("<article>Read me</article><div>" + f"<p>{LONG}</p>" * 40 + "</div>", "Read me " + " ".join([LONG] * 40)),
    "nothing marked": (f"<div><a href=1>Home</a></div><div><a href=2>About</a></div><div><a href=3>More</a></div><h2>Title</h2><p>{LONG}</p><p><a href=q>A link line</a></p><p>{LONG}</p><div><a href=1>Home</a></div><div><a href=2>About</a></div><div><a href=3>Us</a></div><div>(c) 2024 site</div>", f"Title {LONG} A link line {LONG}"),
    "a short end behind an advert": (f"<p>{LONG}</p><div class=ads>Buy now</div><p>The end is here.</p>", f"{LONG} The end is here."),
    "an inline advert": ("<article><p>a <span class='ad'>buy <b>it</b></span> b</p></article>", "a b"),
    "a label in a paragraph": ("<article><p>A <label>word</label> inside.</p></article>", "A word inside."),
    "an article in a part with a sharer's name": ("<article><div class=social><p>All of the text is in here.</p></div></article>", "All of the text is in here."),
    "comments longer than the article": (f"<article><p>Short.</p><div class=comments><p>{LONG}</p></div></article>", "Short."),
    "a lead in an article's header": ("<article><header><h1>Own title</h1><p>The lead.</p><div>by me</div></header><p>Text.</p></article>", "Own title The lead. Text."),
    "a last paragraph of links": (f"<p>{LONG}</p><p><a href=x>The last words</a></p>", f"{LONG} The last words"),
    "paragraphs of links, as many as the window": (f"<p>{LONG}</p>" + "<p><a href=x>One link</a></p>" * 3, LONG),
    "a notice between paragraphs": (f"<p>{LONG} {LONG}</p><div>Buy now!</div><div>(c) us</div>", f"{LONG} {LONG}"),
    "only markup": ("<div><br><p></p></div>", ""),
    "nothing but links": ("<ul><li><a href=x>one</a><li><a href=y>two</a></ul>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert h.extract(page) == want


def plain(weights, walls, window):
    """The method, place by place."""
    n = len(weights)

    def total(k, low, high):  # of the window that ends in line k, of lines between the walls low and high alone
        return sum(weights[j] for j in range(k - window + 1, k + 1) if low < j < high)

    spans = []
    low = -1
    for high in [k for k in range(n) if walls[k]] + [n]:
        if high > low + 1:
            spans.append((low, high, {k: total(k, low, high) for k in range(low + 1, high + window - 1)}))
        low = high
    top = max([v for *_, sums in spans for v in sums.values()], default=0)
    out = []
    for low, high, sums in spans:
        done, k = low + 1, low + 1
        while k < high + window - 1:
            if sums[k] <= 0:
                k += 1
                continue
            surge = k
            while k < high + window - 1 and sums[k] > 0:
                k += 1
            if max(sums[j] for j in range(surge, k)) >= min(h.SURGE, top):
                heavy = [j for j in range(max(done, surge - window + 1), min(k, high)) if weights[j] > 0]
                if heavy:
                    out.append((heavy[0], heavy[-1] + 1))
                    done = heavy[-1] + 1
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_regions_by_brute_force(window):
    rng = random.Random(window)
    for _ in range(400):
        n = rng.randrange(0, 25)
        walls = [rng.random() < 0.1 for _ in range(n)]
        weights = [0 if w else rng.choice([0, 0, 5, 12, 30, 90, -8, -40]) for w in walls]
        assert h.regions(weights, walls, window) == plain(weights, walls, window)


def test_surges_and_dives_decide():
    """Windows of one line keep neither a line of links between paragraphs nor short lines that only together are long enough."""
    lines = h.lines_of(PAGES["nothing marked"][0])
    assert " ".join(h.main_lines(lines)) == PAGES["nothing marked"][1]
    assert " ".join(h.main_lines(lines, window=1)) == f"Title {LONG} {LONG}"
    poem = ["roses are red and as red as can be,", "violets are blue as the eye can see,", "sugar is sweet as all sugar must be"]
    verse = h.lines_of("<div>" + "<br>".join(poem) + "</div><div class=ad>x</div><div>all rights</div><div class=ad>x</div><div>" + LONG + "</div>")
    assert " ".join(h.main_lines(verse)) == " ".join([*poem, LONG])
    assert " ".join(h.main_lines(verse, window=1)) == LONG


def plainly(page):
    """Names gone, and all that tells a part by its tag is a plain div; paragraphs, headings and lists stay."""
    return re.sub(r"<(/?)(?:article|nav|footer|header|aside|main)\b[^>]*>", r"<\1div>", re.sub(r" (?:class|id|role)=\"[^\"]*\"", "", page))


def by_hand(page):
    """The text of a given page's article: these pages are simple."""
    own = re.search(r"<article>(.*?)(?:</article>|<footer|$)", page, re.S)[1]
    lines = re.sub("<[^>]+>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", "\n", own)).split("\n")
    return " ".join(x for x in (" ".join(html.unescape(line).split()) for line in lines) if x)


def test_given_pages_with_and_without_their_tags():
    """As they are, all are right. Made plain, where windows alone tell an advert from a paragraph, no word of the text is lost and few others come in."""
    pages = [r[0] for r in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    kept = taken = changed = 0
    for page in pages:
        want = by_hand(page)
        assert h.extract(page) == want
        found = h.extract(plainly(page))
        got, right = Counter(found.split()), Counter(want.split())
        assert not right - got
        kept, taken, changed = kept + right.total(), taken + got.total(), changed + (found != want)
    assert kept / taken > 0.98 and changed > 0


def test_odd_rows(spark):
    long = "<article>" + f"<p>{LONG} &amp; <b>more</b></p>" * 20_000 + "</article>"
    rows = [(1, "u", "<p>a page</p>", "t", 9), (1, "u", "<p>a page</p>", "t", 9), (None, None, "<p>no id</p>", None, None), (2, "u", None, None, None), (3, "u", "", None, None), (4, "u", long, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in h.extract_text(df).collect()), key=str)
    body = " ".join([f"{LONG} & more"] * 20_000)
    assert got == sorted([(1, "u", "a page", 6), (1, "u", "a page", 6), (0, None, "no id", 5), (2, "u", "", 0), (3, "u", "", 0), (4, "u", body, len(body))], key=str)
    assert h.extract_text(df.limit(0)).count() == 0

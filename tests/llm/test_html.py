"""Main text against a plain second implementation, and pages that are easy to get wrong."""

import re
from html.parser import HTMLParser

import duckdb
import pytest

from vectrail.llm import html_text

PROSE = "A sentence of the text that is long enough to count. " * 4
P, LINK = f"<p>{PROSE}</p>", "<p><a href=x>Linked words {}</a></p>"


class Plain(HTMLParser):
    """(line, linked characters) of pages whose chrome is told by element name or one class."""

    SKIP = {"script", "style", "title", "head", "nav", "footer", "aside", "form", "button"}
    INLINE = {"a", "b", "i", "em", "span", "br", "strong"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.linked, self.skip, self.link, self.levels, self.level = [], "", 0, [], 0, [], 0
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        line = " ".join(self.text.split())
        if line:
            self.lines.append((line, self.linked))
            self.levels.append(self.level)
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.end()
            self.level = int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0
        if tag == "br":
            self.text += " "
        self.link += tag == "a"
        if tag in self.SKIP or self.skip and tag == self.skip[-1] or ("class", "ad") in attrs:
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.end()
            self.level = 0
        self.link -= tag == "a"
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()

    def handle_data(self, data):
        if not self.skip:
            self.text += data
            self.linked += len(data.strip()) if self.link else 0


def plain_text(page):
    """Lines of unmarked pages from the first surge to the last dive, all lines of text where there is no surge."""
    plain = Plain(page)
    lines = plain.lines
    weight = [0 if 2 * linked > len(t) else len(t) for t, linked in lines]
    first = next((i for i, w in enumerate(weight) if w and sum(weight[i : i + 3]) > 80), None)
    if first is None:
        return "\n".join(t for (t, _), w in zip(lines, weight, strict=True) if w)
    last = max(i for i, w in enumerate(weight) if w and sum(weight[i : i + 3]) > 80)
    end = next((i for i in range(last, len(lines)) if not any(weight[i : i + 3])), len(lines))
    bare = [w == 0 for w in weight]
    run = lambda i: any(all(bare[k : k + 3]) and len(bare[k : k + 3]) == 3 for k in range(max(0, i - 2), i + 1))
    # headings above the surge, up to a run of three lines without text of their own
    above, i = [], first
    while i >= 0 and not (i < first and all(j >= 0 and bare[j] and not plain.levels[j] for j in (i, i + 1, i + 2)) and i + 2 <= first):
        above += [i] if plain.levels[i] else []
        i -= 1
    top = next((i for i in above if plain.levels[i] == 1), above[0] if above else first)
    return "\n".join(t for t, _ in lines[top:first]) + "\n" * (top < first) + "\n".join(lines[i][0] for i in range(first, end) if not run(i))


@pytest.mark.parametrize("change", [[], [("nav", "div")], [("nav", "div"), ("footer", "div")]])
def test_unmarked_pages_equal_the_plain_version(sf, change):
    """Pages without article marks, and without menus and footers named as such: the distribution decides."""
    pages = [x for (x,) in duckdb.sql(f"SELECT html FROM '{sf}/pages.parquet'").fetchall() if x]
    for page in pages[:300]:
        page = re.sub(r"</?article>", "", page)
        for a, b in change:
            page = re.sub(rf"<(/?){a}\b", rf"<\g<1>{b}", page)
        assert html_text.main_text(page) == plain_text(page)


def test_unnamed_menus_go_by_the_distribution():
    menu = "".join(f"<div><a href=x>Menu item {i}</a></div>" for i in range(9))
    assert html_text.main_text(f"<div>{menu}</div><h1>Head</h1>{P}<p>Short.</p>{P}<div>{menu}</div>") == f"Head\n{PROSE.strip()}\nShort.\n{PROSE.strip()}"


@pytest.mark.parametrize(
    "page, lines",
    [
        (f'<div class="layout with-sidebar"><article><h1>T</h1>{P}</article><div class="sidebar">{P}</div></div>', ["T", 1]),
        (f"<form action=x><h1>T</h1>{P}<input name=q><button>Go</button></form>", ["T", 1]),
        (f'<article><div class="side-by-side"><p>left</p>{P}</div></article>', ["left", 1]),
        (f'<article>{P}<div id="social-history">{P}</div></article>', [1, 1]),
        (f"<article>tiny teaser</article>{P}{P}{P}", ["tiny teaser", 1, 1, 1]),
        (f'<div class="sidebar-layout"><div>{P}</div></div>', [1]),
        (f'<article>{P}<div class="share"><span>Tell</span> <a>friends</a></div></article><div id=comments><article class=comment>{P}</article></div>', [1]),
        (f"<article><figure><img><figcaption>What it shows</figcaption></figure>{P}</article>", ["What it shows", 1]),
        (f"<main><p>Lead</p>{P}</main><div>{P}</div>", ["Lead", 1]),
        (f"<p>a</p>{LINK}", ["a"]),
        ("<article><p>Short</p></article>", ["Short"]),
        (f'<div hidden>{P}</div><div class="cookie-banner">{P}</div>{P}', [1]),
        (f"<aside>{P}", [1]),
        # foreign elements that close themselves, scripts in comments and comments in scripts
        (f'<article><h1>T</h1>{P}<svg class="i"/>{P}</article><footer><svg class="j"></svg>foot</footer>', ["T", 1, 1]),
        (f"<article>{P}<svg><svg/><g><svg><text>drawn</text></svg></g>drawn</svg>{P}</article>", [1, 1]),
        (f"<!-- <script> removed --><article>{P}</article>", [1]),
        (f"<script>if (a < b) x = '<!-- <p>no</p>';</script ><article>{P}<style>p > a {{}}</style></article>", [1]),
        (f"<article>{P}</article><script>never closed {P}", [1]),
        (f"<article>{P}<math>x{P}</article>", [1, "x", 1]),
        # attribute values are no names
        (f'<article title="a hidden gem">{P}</article>', [1]),
        (f'<div title="the hidden gem">{P}</div>', [1]),
        (f'<article><p data-state="not hidden">Kept</p><p data-class="nav" class=x>Kept too</p>{P}<p hidden=hidden>gone</p><p class="a" hidden>gone</p></article>', ["Kept", "Kept too", 1]),
        (f"<article>{P}<p>See <a href=x title='The hidden valley'>the valley</a> there</p><p title='style=display:none'>shown</p></article>", [1, "See the valley there", "shown"]),
        (f'<div class="ad-free">{P}{P}</div>', [1, 1]),
        # anchors without a target are no links, links that nothing closes end with their block
        (f'<div><a name="top"><h1>T</h1>{P}{P}</div>', ["T", 1, 1]),
        (f"<div><p><a href=x>Linked</p>{P}{P}<p><a href=y>two</a></p></div>", [1, 1]),
        # short lines between the headline and the first paragraph
        (f"<div><a href=/>Home</a></div><div><a href=/a>A</a></div><div><a href=/b>B</a></div><h1>Headline</h1><p>By A. Writer</p><p>1 May</p><p>3 min</p><p>8 views</p>{P}", ["Headline", "By A. Writer", "1 May", "3 min", "8 views", 1]),
        (f"<h1>Site</h1><ul><li><a href=a>a</a><li><a href=b>b</a><li><a href=c>c</a></ul><h2>Headline</h2><p>x</p><p>y</p><p>z</p>{P}", ["Headline", "x", "y", "z", 1]),
    ],
)
def test_pages(page, lines):
    assert html_text.main_text(page).split("\n") == [PROSE.strip() if x == 1 else x for x in lines]

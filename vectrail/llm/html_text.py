"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped to lines, one per block element. Each line has a weight: its text length,
or nothing if most of it is link text or it stands in an element that never holds main text
(menus, forms, page headers and footers, sidebars, notices, adverts, reader comments). On
every page weights are summed over windows of ``SPAN`` lines: where the sum first rises over
``SURGE`` the main text begins (surge point; its heading above belongs to it), where it falls back to nothing after the last
rise it ends (dive point), and all lines between are kept, short ones too, but for runs of
``SPAN`` or more lines without weight (link lists). A page's own marks move edges only: an
``article`` or ``main`` of which lines are kept is kept to its ends, since headlines and
closing words are short; and where such elements hold half of the weight that is kept or
more, lines outside them are not the article. A page without a surge keeps its lines of text.

Elements are told by name, role and class. A class is a hint, not proof: layout wrappers have
such names too, so an element that holds the page's ``main`` or main heading is no chrome,
forms and page headers neither if they hold most of the text, and names that mean several
things (``WEAK``) count only where no line is longer than ``SHORT``.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import table, text_bytes

#: Lines of a window; window sum that begins a region; longest line of an element named in WEAK.
SPAN, SURGE, SHORT = 3, 80, 40

# Elements and their roles.
RAW = {"script", "style", "noscript", "textarea", "iframe", "title"}
FOREIGN = {"svg", "math", "object", "template"}
DROPPED = {"head", "button", "select", "menu", "dialog", "canvas", "audio", "video"}
CHROME = {"nav", "footer", "aside"}
LOOSE = {"form", "header"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
STRONG = re.compile(
    r"ads?|advert\w*|adslot|adbox|banner|breadcrumbs?|comments?|commentlist|disqus|cookies?|consent|gdpr|footer|masthead|menu|modal|nav|navbar|navigation|newsletter"
    r"|notices?|notifications?|overlay|pager|pagination|paywall|popup|promos?|promotion|related|recommend\w*|replies|sidebar|sponsor\w*|subscribe|toolbar"
)
WEAK = {"share", "sharing", "side", "social", "widget"}
LAYOUT = {"with", "has", "no", "without", "is", "not", "layout", "wrapper", "wrap", "container", "page", "grid", "open", "closed", "free"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
SPACE = re.compile(r"\s+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def attributes_of(text: str) -> list[tuple[str, str]]:
    """Names and values of a tag's attributes in lower case, one after the other: what stands in a value is no name."""
    return [(key.lower(), value.strip("\"'").lower()) for key, value in ATTRIBUTE.findall(text)]


def _kind(name: str, attributes: str, in_article: bool) -> str:
    """What an element is: "dropped", "chrome", "loose" (chrome unless it wraps the page), "weak" or "" (content)."""
    if name in DROPPED:
        return "dropped"
    if name in CHROME:
        return "chrome"
    found = "loose" if name == "form" or (name == "header" and not in_article) else ""
    if name in ("html", "body", "main") or not attributes:
        return found
    for key, value in attributes_of(attributes):
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return "dropped"
        if key == "role" and value in ROLES:
            return "chrome"
        if key == "class" or (key == "id" and name not in HEADINGS):
            for parts in (re.split(r"[-_]+", token) for token in value.split()):
                if len(parts) > 3 or LAYOUT & {*parts}:
                    continue
                if STRONG.fullmatch(parts[0]) or STRONG.fullmatch(parts[-1]):
                    return "chrome"
                if len(parts) < 3 and (parts[0] in WEAK or parts[-1] in WEAK):
                    found = found or "weak"
    return found


@dataclass
class Line:
    """A block's text, its characters in links, the elements of interest and the article it stands in, the level of its heading (0: none)."""

    text: str
    linked: int
    inside: tuple[int, ...]
    article: int
    heading: int = 0


def after_raw(page: str, name: str, start: int) -> int:
    """Where an element whose content is no text ends: behind its end tag, or where it begins if nothing ends it.

    Scripts and the like end at their first end tag, else with the page; foreign elements may nest or close themselves.
    """
    if name in RAW:
        found = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, start)
        return found.end() if found else len(page)
    depth = 1
    for m in TOKEN.finditer(page, start):
        if (m[2] or "").lower() == name:
            depth += -1 if m[1] else 0 if m[3].endswith("/") else 1
            if not depth:
                return m.end()
    return start


def lines_of(page: str) -> tuple[list[Line], dict[int, str], set[int]]:
    """Lines of a page, kinds of its elements of interest, and those that hold its main part or heading."""
    lower = page.lower()
    anchors = [(m.start(), bool(m[1])) for m in ANCHOR.finditer(page)]
    out: list[Line] = []
    text: list[str] = []
    kinds, holds, ends = {}, set(), {}
    opened: list[list] = []  # [element name, depth of that name, number], numbers of articles negative
    linked, link, at, number, heading = 0, 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        line = SPACE.sub(" ", html.unescape("".join(text))).strip()
        if line:
            articles = [-e[2] for e in opened if e[2] < 0]
            out.append(Line(line, linked, tuple(e[2] for e in opened if e[2] > 0), articles[0] if articles else 0, heading))
        text.clear()
        linked = 0

    m = TOKEN.search(page)
    while m:
        here, m = m, None
        piece = page[at : here.start()]
        text.append(piece)
        linked += len(piece.strip()) if link else 0
        at = here.end()
        slash, name, attributes = here[1], (here[2] or "").lower(), here[3] or ""
        self_closed = attributes.endswith("/")
        if not slash and (name in RAW or (name in FOREIGN and not self_closed)):
            at = after_raw(page, name, at)
            text.append(" ")
        m = TOKEN.search(page, at)
        if not name or name in RAW or name in FOREIGN:
            continue
        if name in BLOCKS or name in DROPPED:
            close()
            heading = int(name[1]) if name in HEADINGS and not slash else 0
            if link == 2:
                link = 0
        elif name == "br":
            text.append(" ")
        if name == "a":
            link = 0
            if not slash and any(key == "href" for key, _ in attributes_of(attributes)):
                # a link that nothing closes before the next one ends with its block
                k = bisect_right(anchors, (here.start(), True))
                link = 1 if k < len(anchors) and anchors[k][1] else 2
        if name in VOID:
            continue
        if slash:
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] == name:
                    opened[k][1] -= 1
                    if opened[k][1] == 0:
                        close()
                        del opened[k]
            continue
        for e in opened:
            if e[0] == name and not self_closed:
                e[1] += 1
        if name in ("main", "h1", "article"):
            holds |= {(e[2], name) for e in opened if e[2] > 0}
        kind = _kind(name, attributes, any(e[2] < 0 for e in opened))
        if (not kind and name not in ("article", "main")) or self_closed:
            continue
        if name not in ends:
            ends[name] = lower.rfind(f"</{name}")
        if ends[name] > here.start() or name in ("article", "main"):  # chrome that nothing closes drops only its tag
            close()
            number += 1
            opened.append([name, 1, number if kind else -number])
            kinds[number] = kind
    text.append(page[at:])
    close()
    return out, kinds, holds


def chrome_of(lines: list[Line], kinds: dict[int, str], holds: set[tuple[int, str]]) -> set[int]:
    """The elements of interest that really hold no main text."""
    total, own, longest = 0, {}, {}
    for x in lines:
        total += len(x.text)
        for e in x.inside:
            own[e] = own.get(e, 0) + len(x.text)
            longest[e] = max(longest.get(e, 0), len(x.text) - x.linked)
    out = set()
    for e, size in own.items():
        kind = kinds[e]
        wraps = (e, "main") in holds or (kind == "chrome" and (e, "h1") in holds)
        if kind in ("loose", "weak"):
            wraps |= (e, "article") in holds or 2 * size > total
        if kind == "dropped" or (not wraps and (kind != "weak" or longest[e] <= SHORT)):
            out.add(e)
    return out


def between(weight: list[int]) -> list[int]:
    """The lines from the first surge point to the last dive point, but for runs of SPAN or more lines without weight.

    A surge point is a line where the window sum is over SURGE; the sum falls back to nothing
    at its dive point.
    """
    sums = [sum(weight[k : k + SPAN]) for k in range(len(weight))]
    surges = [k for k, w in enumerate(weight) if w and sums[k] > SURGE]
    if not surges:
        return []
    dive = surges[-1]
    while dive < len(weight) and sums[dive] > 0:
        dive += 1
    empty = {k + j for k, x in enumerate(sums[: len(sums) - SPAN + 1]) if x == 0 for j in range(SPAN)}
    return [k for k in range(surges[0], dive) if k not in empty]


def headed(first: int, lines: list[Line], weight: list[int]) -> int:
    """Where the main text begins whose first surge is at ``first``: at the nearest main heading above, else the nearest heading.

    Bylines, dates and the like may lie between; a run of SPAN or more lines without weight may not.
    """
    nearest, bare = first, 0
    for k in range(first, -1, -1):
        bare = 0 if weight[k] or lines[k].heading else bare + 1
        if bare >= SPAN:
            break
        if lines[k].heading == 1:
            return k
        if lines[k].heading and nearest == first:
            nearest = k
    return nearest


def main_text(page: str) -> str:
    """The main text of a page; empty if there is none."""
    lines, kinds, holds = lines_of(page)
    chrome = chrome_of(lines, kinds, holds)
    lines = [x for x in lines if not any(e in chrome and kinds[e] == "dropped" for e in x.inside)]
    barred = [any(e in chrome for e in x.inside) for x in lines]
    weight = [0 if no or 2 * x.linked > len(x.text) else len(x.text) for x, no in zip(lines, barred, strict=True)]
    keep = between(weight)
    if keep:
        keep = [*range(headed(keep[0], lines, weight), keep[0]), *keep]
    else:  # a page of few short lines
        keep = [k for k, w in enumerate(weight) if w]
    articles = {lines[k].article for k in keep if weight[k]} - {0}
    if 2 * sum(weight[k] for k in keep if lines[k].article) >= sum(weight[k] for k in keep):
        keep = [k for k in keep if lines[k].article or not articles]
    keep = sorted({*keep, *(k for k, x in enumerate(lines) if x.article in articles)})
    return "\n".join(lines[k].text for k in keep if not barred[k])


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points), ``column`` left out; one pass, no shuffle.

    Null or empty html gives an empty text, an empty table no rows. Repeated rows are extracted each. Markup may be
    broken: what no tag ends is text, a comment or script without an end takes the rest of the page. Other columns stay,
    except that text and n_chars of ``pages`` give way to the new ones.
    """
    keep = [c for c in pages.columns if c not in (column, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.decode("utf-8", "replace")) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = pages.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return pages.select(*keep, text_bytes(column).alias("_html")).mapInArrow(run, schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; nulls, repeats, broken markup and empty tables as in ``extract``."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op6_html_text": op6_html_text}
ORACLES: dict[str, str] = {}

"""Decontamination, quality, extraction, mixing, personal data, toxicity and language-model scores."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.duck import difference
from tests.llm import rows
from vectrail.llm import decontaminate, html_text, lm_score, mixing, pii, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def folder(spark, tmp_path, data=None):
    """Tables of awkward documents with items and labels."""
    rows.stored(rows.frame(spark, data), tmp_path)
    some = [r for r in rows.documents() if r[1]]
    items = [(1, " ".join(some[0][1].split()[:14])), (2, None), (3, ""), (4, "w1"), (1, some[3][1]), (None, some[5][1]), (6, "w2 w3")]
    rows.stored(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    labels = [(i, i % 2, i % 3 == 0) for i in range(50)] + [(1, 0, 1), (1, 1, 0), (None, 1, 1), (7, None, None)]
    return rows.stored(spark.createDataFrame([(a, b, None if c is None else int(c)) for a, b, c in labels], LABELS), tmp_path, "labels")


@pytest.mark.parametrize("op", [decontaminate, mixing])
@pytest.mark.parametrize("data", [None, []])
def test_sql_on_awkward_rows(spark, tmp_path, op, data):
    where = folder(spark, tmp_path, data)
    ((name, query),) = op.QUERIES.items()
    assert difference(query(spark, where), op.ORACLES[name], where) == ""


def test_items_in_blocks(spark, tmp_path):
    """Many small blocks of items give what one block gives."""
    where = folder(spark, tmp_path)
    docs, items = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/benchmark.parquet")
    a, b = (decontaminate.with_hits(docs.select("doc_id", "text"), items, "c", n).select("doc_id", "c.*") for n in (7, 100_000))
    assert rows.found(a, *a.columns) == rows.found(b, *b.columns)
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns


def plain_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            hit |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("source", ["awkward", "sf", "empty"])
def test_op5(spark, sf, tmp_path, source):
    where = sf if source == "sf" else folder(spark, tmp_path, [] if source == "empty" else None)
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    want = []
    for i, t in data:
        s = plain_stats(t)
        want.append((i, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    got = quality.op5_quality_rules(spark, where)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows.found(got, *columns) == sorted(want, key=repr)
    assert got.where("base_failed AND kept").count() == 0


def test_quality_filter_keeps_columns(spark):
    docs = rows.frame(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS)
    assert quality.filter_quality(docs, labels).columns == docs.columns


def test_cutoffs_bound_false_rejection():
    """The bound is exact: no certified cutoff rejects more held-out good ones than the tail allows."""
    assert quality._tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert quality._tail(2, 5, 0.3) == pytest.approx(sum(math.comb(5, k) * 0.3**k * 0.7 ** (5 - k) for k in range(3)))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><header>Site</header>
<div class="cookie-notice">We use cookies</div><article><h1>Head&amp;line</h1><p>First   paragraph
of &lt;text&gt;.</p><p>Short.</p><aside>Advert</aside><form><button>Go</button></form><ul><li>One item<li>Two</ul></article>
<section id="comments"><p>A reader says something quite long about this article and goes on for a while here.</p></section>
<footer>(c)</footer><script>var a = "<p>no</p>"</script></body></html>"""


def test_op6(spark, tmp_path):
    pages = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "<p>a"), (None, "v", "no markup at all"), (1, "u", PAGE), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    rows.stored(spark.createDataFrame(pages, "page_id long, url string, html string"), tmp_path, "pages")
    got = html_text.op6_html_text(spark, str(tmp_path)).collect()
    text = "Head&line\nFirst paragraph of <text>.\nShort.\nOne item\nTwo"
    assert sorted((r["text"], r["n_chars"]) for r in got if r["page_id"] == 1) == [(text, len(text))] * 2
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] in (2, 3, 4, 5)} == {2: "", 3: "", 4: "a", 5: "deep"}
    rows.stored(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path, "pages")
    assert html_text.op6_html_text(spark, str(tmp_path)).count() == 0


def test_split_articles_are_whole():
    """Linked lines of a marked article stay; elsewhere sections after a link list stay, the list goes."""
    link, long = "<p><a href=x>Linked {}</a></p>", "A sentence of the text that is long enough to count. " * 4
    marked = "<article>" + "".join(link.format(i) for i in range(4)) + f"<p>{long}</p>" + link.format(9) + "</article><p>" + long + "</p>"
    assert html_text.main_text(marked).split("\n") == [*(f"Linked {i}" for i in range(4)), long.strip(), "Linked 9"]
    links = "".join(link.format(i) for i in range(4))
    page = f"<div>{links}</div>" + f"<p>{long}</p>" * 20 + links + "<h2>Short</h2><p>lines.</p>" + links + f"<p>Close.</p><p>{long}</p><div>{links}</div>"
    assert html_text.main_text(page).split("\n") == [*[long.strip()] * 20, "Short", "lines.", "Close.", long.strip()]


def test_op7_mix(spark):
    docs = rows.frame(spark)
    out = mixing.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and "_taken" in out.columns
    assert mixing.mix(rows.frame(spark, [])).count() == 0


def plain_spans(text):
    text, out = text or "", []
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    for kind, (pattern, good) in kinds.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return out


PRIVATE = [
    "mail a.b@c.de, x@y.z@w.v.u! 1.2.3.4 1.2.3.4.5 300.1.1.1 10.0.0.1", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 end", "call +1 (555) 010-9999 now +49.30.123456 +1 2",
    "日本 naïve😀 a@b.co 😀 +44 20 7946 0958 9" + "9" * 30, "a" * 3000 + "@", "1" * 5000, "1." * 3000, "%%%@@a.b@c", "+1" + "." * 500 + "2", "4111111111111111 4111111111111111", "1.2.3.4.5.6.7.8", "é" * 100 + "x.y@z.w",
]


@pytest.mark.parametrize("source", ["awkward", "sf"])
def test_op8(spark, sf, tmp_path, source):
    extra = [(1000 + i, t, "en", "web", len(t), "k", 1, "s", "t", "kept", 5, "r") for i, t in enumerate(PRIVATE)]
    where = sf if source == "sf" else folder(spark, tmp_path, rows.documents() + extra)
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    want = []
    for i, t in data:
        s = plain_spans(t)
        n = Counter(k for k, _, _ in s)
        want.append((i, *[n[k] for k in pii.BASE], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    got = pii.op8_pii_spans(spark, where)
    assert rows.found(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    spans = {(r["doc_id"]): r["spans"] for r in got.collect()}
    for i, t in data:
        if i is not None and i < 60:
            assert {f"{k}:{a}:{b}" for k, a, b in plain_spans(t)} <= set(spans[i].split(","))


def test_redaction(spark):
    clash = ("en", "web", 1, "k", 1, "s", "t", "kept", 5, "r")
    docs = rows.frame(spark, [(1, "write to a.b@c.de or +1 555 010 9999 é x@y.org", *clash), (2, None, *clash), (3, "", *clash), (4, "nothing here", *clash)])
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "write to [EMAIL] or [PHONE] é [EMAIL]", 2: None, 3: "", 4: "nothing here"}
    assert pii.redact(docs).columns == docs.columns and pii.redact(rows.frame(spark, [])).count() == 0


def test_long_secret_is_one_span(spark):
    """A secret's span reaches the end of its value, however long."""
    docs = spark.createDataFrame([("set token=" + "aB3_" * 500 + " end",), ("api_key: " + "x9" * 50_000,)], "text string")
    got = [[(s["kind"], s["start"], s["end"]) for s in r["s"]] for r in docs.select(pii.candidates(docs["text"]).alias("s")).collect()]
    assert got == [[("secret", 4, 2010)], [("secret", 0, 100_009)]]


def test_op9(spark, tmp_path):
    """Awkward rows get scores; held-out accuracy on the larger table."""
    where = folder(spark, tmp_path)
    got = toxicity.op9_toxicity(spark, where)
    assert got.count() == len(rows.documents()) and got.where("p_toxic IS NULL").count() == 0
    where = folder(spark, tmp_path, [])
    assert toxicity.op9_toxicity(spark, where).count() == 0
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    train, test = labels.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 = 0")
    s = toxicity.score(docs, *toxicity.fit(toxicity.sample(docs, train))).join(test.selectExpr("doc_id", "toxic AS truth"), "doc_id")
    tp, fp, fn = s.selectExpr("count_if(toxic AND truth = 1)", "count_if(toxic AND truth = 0)", "count_if(NOT toxic AND truth = 1)").first()
    print("held-out", tp, fp, fn)
    assert 2 * tp / max(1, 2 * tp + fp + fn) > 0.7

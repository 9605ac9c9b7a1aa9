"""Personal data: labelers vote on candidate spans, EM weighs them, a classifier decides.

Everything that touches texts is a DataFrame expression. Candidate spans come from the
base patterns (always kept) and from looser ones. Four labelers vote +1, -1 or 0 on each:
form (the strict pattern and its checks), gazetteer (known providers, issuers, country
codes, key names), context (cue words before the span) and boundary (what touches the
span). Counts by vote pattern -- at most kinds * 3**4 rows, whatever the corpus -- go
through expectation-maximisation, which estimates each labeler's reliability without
labels, and the posteriors train a logistic classifier over kind and votes. It is applied
as a column expression.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import materialize, table, unused

# A local part starts where the last match ended or after a character that can't be in
# one, so runs are scanned once; possessive repeats keep Java's matcher off its stack. The
# matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TEL = r"(?<![0-9+(]|\+[0-9]{1,3}[ .-]{0,2})(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"  # not part of an international one
SECRET = r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+=.-]{8,}+"

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "tel", "secret")
VOTES = ("form", "gazetteer", "context", "boundary")

# What the gazetteer knows.
PROVIDERS = r"(?i)@(?:[a-z0-9-]+\.)*(?:gmail|yahoo|outlook|hotmail|icloud|proton|aol|gmx|web|orange|free|mail[0-9]*|example)\.(?:[a-z]{2,10}\.)?[a-z]{2,6}$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|6011|65|62)"
COUNTRY_CODES = r"^\+ ?(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
KEY_NAMES = r"(?i)^(?:api[_-]?key|access[_-]?key|secret|token|password|passwd)"
RESERVED_NETS = r"^(?:0|255)\."

# Cue words before a span, for and against.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|correo|courriel|write to|from|by)\W*$",
    "ip": r"(?i)(?:\bip|address|host|from|server|client|login)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|credit|debit|carte|karte|tarjeta|pay)\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon|llam\w*)\W*$",
    "account": r"(?i)(?:card|account|iban|konto|compte|cuenta)\W*$",
    "tel": r"(?i)(?:phone|tel|call|mobile|fax|telefon)\W*$",
    "secret": r"(?i)(?:export|set|env|config|auth\w*)\W*$",
}
AGAINST = r"(?i)(?:version|isbn|issn|doi|order|invoice|build|release|https?://\S*)\W*$"


#: Matches that are put together at once, characters before a span that are looked at.
CHUNK, BEFORE = 64, 24
FOUND = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, before, after>> of all matches, in code points.

    The pieces between matches and the matches themselves alternate, so offsets are running
    sums of their lengths, and what stands before and after a match comes from its
    neighbours: the text is read once, however many matches it has. Sums run by chunks of
    matches, whose arrays are joined at the end, so that no array is copied per match.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    after = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  (a value that is worked out once)
    zipped = lambda w: F.arrays_zip(w["p"].alias("p"), w["m"].alias("m"), after(w["p"]).alias("np"), after(w["m"]).alias("nm"))
    cut = lambda z: F.transform(F.sequence(F.lit(1), F.size(z), F.lit(CHUNK)), lambda i: F.slice(z, i, CHUNK))
    chunks = once(once(F.struct(pieces.alias("p"), found.alias("m")), zipped), cut)
    text_of = lambda c: F.coalesce(c, F.lit(""))
    last = lambda c: F.substr(c, F.lit(-BEFORE))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["p"])
        before = last(F.concat(acc["tail"], last(x["p"])))
        end = start + F.length(text_of(x["m"]))
        follows = F.substring(F.concat(text_of(x["np"]), text_of(x["nm"])), 1, 1)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"), before.alias("before"), follows.alias("after")))
        return F.struct(end.alias("pos"), last(F.concat(before, text_of(x["m"]))).alias("tail"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        empty = F.struct(acc["pos"].alias("pos"), acc["tail"].alias("tail"), F.array().cast(FOUND).alias("out"))
        return once(F.aggregate(part, empty, step), lambda r: F.struct(r["pos"].alias("pos"), r["tail"].alias("tail"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"), F.array().cast(f"array<{FOUND}>").alias("outs"))
    return F.aggregate(chunks, start, chunk, lambda acc: F.flatten(acc["outs"]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the checksum."""

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        y = F.when(i % 2 == 0, x * 2).otherwise(x)
        return acc + F.when(y > 9, y - 9).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _votes(kind: str, form: Column, gazetteer: Column, s: Column) -> Column:
    before, after = s["before"], s["after"]
    context = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0)
    boundary = F.when(before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]"), -1).otherwise(1)
    return F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind in BASE).alias("base"),
        form.cast("int").alias("form"), gazetteer.cast("int").alias("gazetteer"), context.alias("context"), boundary.alias("boundary"),
    )


def _yes(c: Column) -> Column:
    return F.when(c, 1).otherwise(-1)


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, base, votes...>> of a text, by kind, then start."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast(FOUND)
    some = lambda cheap, pattern: F.when(cheap, matches(t, pattern)).otherwise(none)
    digit = t.rlike("[0-9]")
    card_ok = lambda s: F.length(_digits(s["match"])).between(13, 19)
    runs = F.filter(some(digit, CARD), card_ok)
    valid = lambda s: luhn(_digits(s["match"]))
    of = lambda kind, found, form, gaz: F.transform(found, lambda s: _votes(kind, form(s), gaz(s), s))
    one, minus = (lambda s: F.lit(1)), (lambda s: F.lit(-1))
    ips = F.filter(some(digit & t.contains("."), IP), lambda s: F.forall(F.split(s["match"], r"\."), lambda p: p.cast("double") <= 255))
    phones = F.filter(some(t.contains("+"), PHONE), lambda s: F.length(_digits(s["match"])).between(9, 15))
    return F.concat(
        of("email", some(t.contains("@"), EMAIL), one, lambda s: F.when(s["match"].rlike(PROVIDERS), 1).otherwise(0)),
        of("ip", ips, one, lambda s: _yes(~s["match"].rlike(RESERVED_NETS))),
        of("card", F.filter(runs, valid), one, lambda s: _yes(_digits(s["match"]).rlike(ISSUERS))),
        of("phone", phones, one, lambda s: _yes(s["match"].rlike(COUNTRY_CODES))),
        of("account", F.filter(runs, lambda s: ~valid(s)), minus, lambda s: _yes(_digits(s["match"]).rlike(ISSUERS))),
        of("tel", some(digit, TEL), one, lambda s: F.when(s["match"].startswith("("), 1).otherwise(0)),
        of("secret", some(t.rlike("[=:]"), SECRET), lambda s: _yes(s["match"].rlike("[0-9]")), lambda s: _yes(s["match"].rlike(KEY_NAMES))),
    )


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior that spans of a (kind, votes) pattern are personal data, by EM.

    One reliability table P(vote | truth) per labeler, one prior per kind; the start is
    the share of votes in favour.
    """
    post = {(k, v): min(0.9, max(0.1, 0.5 + sum(v) / (2.0 * len(v)))) for k, v, _ in patterns}
    for _ in range(rounds):
        prior = {}
        for kind in {k for k, _, _ in patterns}:
            of = [(post[k, v], n) for k, v, n in patterns if k == kind]
            prior[kind] = (1 + sum(p * n for p, n in of)) / (2 + sum(n for _, n in of))
        rate = {}
        for j in range(len(VOTES)):
            for truth in (0, 1):
                weight = {x: 1.0 for x in (-1, 0, 1)}
                for k, v, n in patterns:
                    weight[v[j]] += n * (post[k, v] if truth else 1 - post[k, v])
                total = sum(weight.values())
                rate |= {(j, truth, x): w / total for x, w in weight.items()}
        for k, v, _ in patterns:
            odds = math.log(prior[k] / (1 - prior[k])) + sum(math.log(rate[j, 1, x] / rate[j, 0, x]) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def train(patterns: list[tuple[str, tuple[int, ...], int]], post: dict, rounds: int = 400, rate: float = 0.5) -> dict[str, float]:
    """Weights of a logistic classifier over kind and votes, fitted to the posteriors."""
    names = [*KINDS, *[f"{v}{s}" for v in VOTES for s in "+-"]]
    w = dict.fromkeys(names, 0.0)
    active = lambda k, v: [k, *[f"{VOTES[j]}{'+' if x > 0 else '-'}" for j, x in enumerate(v) if x]]
    rows = [(active(k, v), post[k, v], math.sqrt(n)) for k, v, n in patterns]
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        g = dict.fromkeys(names, 0.0)
        for on, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[f] for f in on)))))
            for f in on:
                g[f] += n * (y - p)
        for f in names:
            w[f] += rate * (4 * g[f] / total - 0.001 * w[f])
    return w


def fit(spans: DataFrame, column: str = "spans") -> dict[str, float]:
    """Classifier weights from the vote patterns of all spans (counts only reach the driver)."""
    rows = spans.select(F.explode(column).alias("s")).groupBy("s.kind", *[f"s.{v}" for v in VOTES]).agg(F.count("*").alias("n")).collect()
    patterns = sorted((r["kind"], tuple(r[v] for v in VOTES), r["n"]) for r in rows)
    return train(patterns, estimate(patterns))


def accepted(spans: Column, weights: dict[str, float]) -> Column:
    """The spans that are kept: all base ones, others if the classifier says so."""

    def score(s: Column) -> Column:
        kind = reduce(lambda c, k: c.when(s["kind"] == k, weights[k]), KINDS[1:], F.when(s["kind"] == KINDS[0], weights[KINDS[0]]))
        return reduce(lambda a, v: a + F.when(s[v] > 0, weights[f"{v}+"]).when(s[v] < 0, weights[f"{v}-"]).otherwise(0.0), VOTES, kind)

    return F.filter(spans, lambda s: s["base"] | (score(s) > 0))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each accepted span of ``text`` replaced by its kind in brackets.

    Overlapping spans become one. Null stays null; other columns, repeated rows and
    texts without spans are unchanged. An empty table stays empty.
    """
    spans = unused("spans", docs)
    # written once: the fit reads only the spans, and no later expression searches the texts again
    d = materialize(docs.withColumn(spans, candidates(F.col("text"))), "pii-candidates")
    d = d.withColumn(spans, accepted(F.col(spans), fit(d, spans)))
    in_order = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["pos"] + 1, s["start"] - acc["pos"])
        out = F.when(s["start"] >= acc["pos"], F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    clean = F.aggregate(in_order, F.expr("struct(0 AS pos, '' AS out)"), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.length("text"))))
    return d.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))).drop(spans)


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, in code points.

    Null and empty texts have no spans. Repeated rows are judged each, equal texts alike.
    Spans of different kinds may overlap; of one kind they are leftmost and never do. An
    empty table gives no rows. Only doc_id and text are read, so other columns don't matter.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", candidates(F.col("text")).alias("spans"))
    docs = materialize(docs, "pii-spans")
    weights = fit(docs)
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["base"]), name), ",")
    return docs.select("doc_id", *map(count, BASE), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(accepted(F.col("spans"), weights), name), ",").alias("spans"))


QUERIES = {"op8_pii_spans": op8_pii_spans}
ORACLES: dict[str, str] = {}

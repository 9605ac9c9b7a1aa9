"""Certified cutoffs against a plain version, and what they promise."""

import math
import random

from tests.llm.test_rest import plain_stats
from vectrail.llm import quality

BINS, LEVELS = quality.BINS, quality.LEVELS


def plain_rules(text):
    n, chars, symbols, dup, repeat = plain_stats(text)
    lines = len([x for x in (text or "").split("\n") if x.split()])
    shares = {"symbols": symbols / max(chars, 1), "dup_lines": dup / max(lines, 1), "repeats": repeat / max(n, 1), "long_words": min(chars / max(n, 1), 50) / 50}
    return {k: math.ceil(min(1.0, v) * BINS) for k, v in shares.items()}, n < 10 or 100 * repeat > 20 * n


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def plain_kept(data, good_of, fold_of, alpha, delta):
    """doc_id -> kept by plain loops over lists."""
    marked = {i: (lang, *plain_rules(t)) for i, t, lang in data}
    known = {i: g for i, g in good_of.items() if i in marked and not marked[i][2]}
    strata = {marked[i][0] for i in known if fold_of[i] == 0}
    limits = {}
    for lang in strata:
        first = {g: [marked[i][1] for i, x in known.items() if x == g and fold_of[i] == 0 and marked[i][0] == lang] for g in (0, 1)}
        held = [marked[i][1] for i, x in known.items() if x == 1 and fold_of[i] == 1 and marked[i][0] == lang]
        share = lambda g, k, b: sum(r[k] > b for r in first[g]) / max(len(first[g]), 1)  # noqa: B023, E731
        cuts = {k: [] for k in quality.RULES}
        for level in LEVELS:
            for k, c in cuts.items():
                fit = [b for b in range(BINS + 1) if share(1, k, b) <= level and share(0, k, b) > 20 * share(1, k, b)]
                c.append(min([*c, min(fit, default=math.inf)]))
        best, chosen = 0.0, None
        for at in range(len(LEVELS)):
            hits = lambda rows: sum(any(r[k] > c[at] for k, c in cuts.items()) for r in rows)  # noqa: B023, E731
            k = hits(held)
            if not held or k > alpha * len(held) or tail(k, len(held), alpha) > delta / len(strata):
                break
            gain = hits(first[0]) / max(len(first[0]), 1) - 20 * hits(first[1]) / max(len(first[1]), 1)
            if gain > best:
                best, chosen = gain, at
        limits[lang] = {k: c[chosen] for k, c in cuts.items()} if chosen is not None else {}
    return {i: not bad and not any(r[k] > c for k, c in limits.get(lang, {}).items()) for i, (lang, r, bad) in marked.items()}, limits


def corpus(n, seed=3):
    r = random.Random(seed)
    out, labels = [], {}
    for i in range(n):
        bad, lang = r.random() < 0.3, r.choice(["en", "en", "en", "de", None])
        words = [r.choice("abcdefghij") * r.randint(2, 9) + str(r.randint(0, 999)) for _ in range(r.randint(12, 40))]
        if bad:
            words = [w + ("$#" * r.randint(0, 4)) for w in words]
        elif r.random() < 0.01:
            words[0] = "$" * 60
        out.append((i, " ".join(words) + ("\n" + "same line here\n" * 3 if bad and r.random() < 0.5 else ""), lang))
        labels[i] = int(not bad)
    return out, labels


def test_kept_equals_the_plain_version(spark, tmp_path):
    data, good = corpus(4000)
    spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, g, 0) for i, g in good.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    fold = {r["doc_id"]: r["f"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id", "cast(pmod(xxhash64(doc_id), 2L) AS int) AS f").collect()}
    want, limits = plain_kept(data, good, fold, quality.ALPHA, quality.DELTA)
    assert limits["en"] and not limits[None]  # labels enough for one stratum, too few for the other
    assert {r["doc_id"]: r["kept"] for r in quality.op5_quality_rules(spark, str(tmp_path)).collect()} == want
    lost = [not want[i] for i, _, lang in data if good[i] and lang == "en"]
    assert sum(lost) <= quality.ALPHA * len(lost)
    caught = [not want[i] for i, _, lang in data if not good[i] and lang == "en"]
    assert sum(caught) > 0.5 * len(caught)


def test_clashing_columns(spark):
    data, good = corpus(60)
    docs = spark.createDataFrame([(*d, "x", 1.0, "k", 2) for d in data], "doc_id long, text string, lang string, stratum_key string, cut_symbols double, kept string, n_words int")
    labels = spark.createDataFrame([(i, g) for i, g in good.items()], "doc_id long, quality int")
    assert quality.filter_quality(docs, labels).columns == docs.columns and quality.filter_quality(docs, labels).count() > 0
